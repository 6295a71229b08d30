"""All queries of this folder."""

from . import bpe, contamination, fingerprint, grammar, near, quality, repeats, suffix, toxicity, warc

MODULES = (warc, quality, toxicity, bpe, repeats, contamination, suffix, fingerprint, near, grammar)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
