"""SQL over any number of tables, named table1, table2 and so on."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.naming import header

_TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_]\w*|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\|\||<>|[<>!=]=|\s+|.""", re.S)
_NAMES = {"ifnull": "coalesce", "iif": "if", "unicode": "ascii", "json_extract": "get_json_object"}
#: Functions of whole numbers whatever they are given, and of what they are given.
_COUNTING = {"count", "length", "instr", "unicode", "row_number", "rank", "dense_rank", "ntile", "char_length", "ascii"}
_KEEPING = {"sum", "min", "max", "abs", "coalesce", "ifnull", "nullif"}
_TIMES = {"date": "%Y-%m-%d", "time": "%H:%M:%S", "datetime": "%Y-%m-%d %H:%M:%S", "julianday": "%J", "strftime": ""}
#: Words before a bracket that aren't functions.
_WORDS = set("select where and or not on when then else by in having case between like glob rlike distinct all as from join using limit offset values union except intersect is end with".split())
_PARTS = {"Y": "'yyyy'", "m": "'MM'", "d": "'dd'", "H": "'HH'", "M": "'mm'", "S": "'ss'", "j": "'DDD'", "f": "'ss.SSS'", "F": "'yyyy-MM-dd'", "T": "'HH:mm:ss'", "R": "'HH:mm'"}


class _Rewrite:
    """Rewrites a statement token by token; blanks stay where they are."""

    def __init__(self, text: str, ints: frozenset[str], columns: frozenset[str]):
        self.ints, self.columns = ints, columns
        self.t = [t for t in _TOKEN.findall(text) if not t.startswith(("--", "/*"))]
        low = [t.lower() for t in self.t if not t.isspace()]
        self.aliases = {b.strip('"`') for a, b in zip(low, low[1:]) if a == "as"} | {a.strip('"`') for a, b in zip(low, low[1:]) if b == "."}

    def after(self, k: int) -> int:
        """The next solid token from k on."""
        while k < len(self.t) and self.t[k].isspace():
            k += 1
        return k

    def before(self, k: int) -> int:
        while k >= 0 and self.t[k].isspace():
            k -= 1
        return k

    def close(self, k: int) -> int:
        """The bracket that closes the one at k."""
        depth = 0
        while k < len(self.t):
            depth += (self.t[k] == "(") - (self.t[k] == ")")
            if not depth:
                return k
            k += 1
        raise ValueError("A bracket isn't closed")

    def open(self, k: int) -> int:
        depth = 0
        while k >= 0:
            depth += (self.t[k] == ")") - (self.t[k] == "(")
            if not depth:
                return k
            k -= 1
        raise ValueError("A bracket isn't opened")

    def arguments(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Ranges of the arguments between brackets."""
        out, depth, start = [], 0, lo
        for k in range(lo, hi):
            depth += (self.t[k] == "(") - (self.t[k] == ")")
            if self.t[k] == "," and not depth:
                out.append((start, k))
                start = k + 1
        return out + [(start, hi)] if self.after(lo) < hi else []

    def whole(self, lo: int, hi: int) -> bool:
        """Whether an expression is surely of whole numbers."""
        k, any_ = self.after(lo), False
        while k < hi:
            t = self.t[k].lower()
            n = self.after(k + 1)
            if n < hi and self.t[n] == "(" and re.match(r"[a-z_]", t):
                end = self.close(n)
                if t == "cast":
                    kinds = [x.lower() for x in self.t[n:end] if not x.isspace()]
                    if not {"integer", "int", "bigint"} & set(kinds[-2:]):
                        return False
                elif t in _KEEPING:
                    if not all(self.whole(a, b) for a, b in self.arguments(n + 1, end)):
                        return False
                elif t not in _COUNTING:
                    return False
                k, any_ = self.after(end + 1), True
                if k < hi and self.t[k].lower() == "over":  # a window
                    k = self.after(k + 1)
                    k = self.after(self.close(k) + 1)
                continue
            if t.strip('"`') in self.ints or re.fullmatch(r"\d+", t):
                any_ = True
            elif n < hi and self.t[n] == ".":
                k = self.after(n + 1)
                continue
            elif t not in ("+", "-", "*", "/", "%", "(", ")"):
                return False
            k = n
        return any_

    def left(self, k: int) -> int:
        """Where the operand before the operator at k begins: factors joined by
        the operators of the same rank."""
        while True:
            k = self.before(k - 1)
            if k >= 0 and self.t[k] == ")":
                k = self.open(k)
                p = self.before(k - 1)
                if p >= 0 and re.match(r"[A-Za-z_]", self.t[p]) and self.t[p].lower() not in _WORDS:
                    if self.t[p].lower() == "over":
                        p = self.before(self.open(self.before(p - 1)) - 1)
                    k = p
            while (p := self.before(k - 1)) >= 0 and self.t[p] == ".":
                k = self.before(p - 1)
            p = self.before(k - 1)
            if p < 0 or self.t[p] not in ("*", "/", "%"):
                return k
            k = p

    def right(self, k: int) -> int:
        """Where the factor that begins at k ends."""
        k = self.after(k)
        while k < len(self.t) and self.t[k] in ("-", "+"):
            k = self.after(k + 1)
        while True:
            n = self.after(k + 1)
            if self.t[k] == "(":
                return self.close(k) + 1
            if n < len(self.t) and self.t[n] == ".":
                k = self.after(n + 1)
            elif n < len(self.t) and self.t[n] == "(" and re.match(r"[A-Za-z_]", self.t[k]):
                end = self.close(n)
                o = self.after(end + 1)
                if o < len(self.t) and self.t[o].lower() == "over":
                    end = self.close(self.after(o + 1))
                return end + 1
            else:
                return k + 1

    def run(self, lo: int = 0, hi: int | None = None) -> str:
        hi = len(self.t) if hi is None else hi
        out, k = [], lo
        while k < hi:
            t = self.t[k]
            low = t.lower()
            n = self.after(k + 1)
            call = n < hi and self.t[n] == "(" and re.match(r"[A-Za-z_]", t)
            if t[0] == '"':
                out.append(self.quoted(k))
            elif low == "like":
                out.append("ILIKE")
            elif low == "glob":
                p = self.after(k + 1)
                pattern = self.t[p]
                if pattern[0] != "'":
                    raise ValueError("GLOB needs a literal pattern")
                out.append("RLIKE '" + _glob(pattern[1:-1].replace("''", "'")).replace("\\", "\\\\").replace("'", "\\'") + "'")
                k = p
            elif t in ("/", "%"):
                end = self.right(k + 1)
                by = f"nullif({self.run(self.after(k + 1), end)}, 0)"  # by zero is null
                whole = t == "/" and self.whole(self.left(k), k) and self.whole(k + 1, end)
                out.append(f" {'DIV' if whole else t} {by}")
                k = end - 1
            elif call:
                end = self.close(n)
                done = self.call(low, t, n, end)
                if done is None:
                    out.append(t)
                else:
                    out.append(done)
                    k = end
            else:
                out.append(t.replace("\\", "\\\\") if t[0] == "'" else t)
            k += 1
        return "".join(out)

    def quoted(self, k: int) -> str:
        """A name, or a text if nothing has that name."""
        name = self.t[k][1:-1].replace('""', '"')
        p, n = self.before(k - 1), self.after(k + 1)
        named = p >= 0 and (self.t[p] == "." or self.t[p].lower() in ("as", "from", "join")) or n < len(self.t) and self.t[n] == "."
        if named or name.lower() in self.columns or name.lower() in self.aliases:
            return "`" + name.replace("`", "``") + "`"
        return "'" + name.replace("'", "''") + "'"

    def call(self, low: str, name: str, n: int, end: int) -> str | None:
        parts = self.arguments(n + 1, end)
        args = lambda: [self.run(a, b).strip() for a, b in parts]
        if low == "total":
            return f"coalesce(sum({', '.join(args())}), 0.0D)"
        if low == "group_concat":
            return f"string_agg({', '.join(args() + [chr(39) + ',' + chr(39)] * (len(parts) == 1))})"
        if low in ("min", "max") and len(parts) > 1:
            every = args()  # a null among them makes null
            return f"if({' OR '.join(f'({x}) IS NULL' for x in every)}, NULL, {'least' if low == 'min' else 'greatest'}({', '.join(every)}))"
        if low == "char":
            return "concat(" + ", ".join(f"chr({x})" for x in args()) + ")"
        if low == "random" and not parts:
            return "CAST((rand() - 0.5D) * 18446744073709551615D AS BIGINT)"
        if low == "typeof":
            x = f"typeof({args()[0]})"
            return f"CASE WHEN {args()[0]} IS NULL THEN 'null' WHEN {x} IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN {x} IN ('float', 'double') OR {x} LIKE 'decimal%' THEN 'real' WHEN {x} = 'binary' THEN 'blob' ELSE 'text' END"
        if low in _TIMES:
            return self.time(low, args())
        if low in _NAMES:
            return f"{_NAMES[low]}({', '.join(args())})"
        return None

    def time(self, low: str, args: list[str]) -> str:
        pattern = _TIMES[low]
        if low == "strftime":
            pattern, args = _literal(args[0]), args[1:]
        value = "current_timestamp()" if not args or args[0].lower() == "'now'" else f"CAST({args[0]} AS TIMESTAMP)"
        for m in map(_literal, args[1:]):
            step = re.fullmatch(r"\s*([+-]?\d+(?:\.\d+)?)\s+(year|month|day|hour|minute|second)s?\s*", m, re.I)
            if step and step[2].lower() in ("year", "month"):
                value = f"({value} + make_interval({step[1]}))" if step[2].lower() == "year" else f"({value} + make_interval(0, {step[1]}))"
            elif step:
                value = f"({value} + make_dt_interval({', '.join(step[1] if u == step[2].lower() else '0' for u in ('day', 'hour', 'minute', 'second'))}))"
            elif start := re.fullmatch(r"start of (year|month|day)", m, re.I):
                value = f"date_trunc('{start[1]}', {value})"
            elif day := re.fullmatch(r"weekday ([0-6])", m, re.I):
                value = f"({value} + make_dt_interval(pmod({day[1]} - dayofweek({value}) + 1, 7)))"
            else:
                raise ValueError(f"Unknown modifier: {m}")
        day = f"(unix_micros({value}) / 86400000000D + 2440587.5D)"
        if low == "julianday":
            return day
        pieces = []
        for x in re.findall(r"%.|[^%]+", pattern, re.S):
            if x[0] != "%":
                pieces.append("'" + x.replace("'", "''") + "'")
            elif x[1] in _PARTS:
                pieces.append(f"date_format({value}, {_PARTS[x[1]]})")
            elif x[1] in "swWJ%":
                pieces.append({"s": f"CAST(unix_seconds({value}) AS STRING)", "w": f"CAST(dayofweek({value}) - 1 AS STRING)", "W": f"lpad(CAST((dayofyear({value}) + 6 - weekday({value})) DIV 7 AS STRING), 2, '0')", "J": f"CAST({day} AS STRING)", "%": "'%'"}[x[1]])
            else:
                raise ValueError(f"Unknown part of a date: {x}")
        return pieces[0] if len(pieces) == 1 else f"concat({', '.join(pieces)})"


def _literal(text: str) -> str:
    if text[:1] != "'":
        raise ValueError("Formats and modifiers must be literals")
    return text[1:-1].replace("''", "'")


def _glob(pattern: str) -> str:
    """A pattern of *, ? and [...] as a regular expression for whole texts."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + (3 if pattern[k + 1 : k + 2] == "^" else 2)) if c == "[" else -1
        if end > 0:
            inner = pattern[k + 1 : end]
            out.append("[" + ("^" if inner[0] == "^" else "") + re.sub(r"([\\\[\]&^])", r"\\\1", inner.lstrip("^") if inner[0] == "^" else inner) + "]")
            k = end
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        k += 1
    return "(?s)^" + "".join(out) + "$"


def dialect(text: str, int_columns: frozenset[str] = frozenset(), columns: frozenset[str] = frozenset()) -> str:
    """Rewrite what SQLite spells otherwise: names and texts in double quotes
    (a text if no column or alias has the name), LIKE without regard to case,
    GLOB, / of whole numbers (of literals, ``int_columns`` and what is made of
    them), division by zero, total(), group_concat(), dates and times, and
    several functions."""
    return _Rewrite(text, int_columns, columns or int_columns).run()


def query(spark: SparkSession, text: str, *tables: DataFrame, args: list | dict | None = None, sqlite: bool = True) -> DataFrame:
    """The result of a statement over ``tables``; a bare predicate filters
    their cross product.  Output names are unique slugs."""
    if not re.match(r"\s*(select|with|values|from)\b", text, re.I):
        text = f"SELECT * FROM {', '.join(f'table{k}' for k in range(1, len(tables) + 1))} WHERE {text}"
    mark = uuid.uuid4().hex[:8]
    for k, t in enumerate(tables, 1):
        t.createOrReplaceTempView(f"table{k}_{mark}")
    ints = frozenset(c.lower() for t in tables for c, kind in t.dtypes if kind in ("int", "bigint", "smallint", "tinyint"))
    text = dialect(text, ints, frozenset(c.lower() for t in tables for c in t.columns)) if sqlite else text
    # texts are put aside, lest a table's name in one be taken for the table
    said: list[str] = []
    text = re.sub(r"'(?:[^'\\]|\\.|'')*'", lambda m: f"'{said.append(m[0]) or len(said) - 1}'", text, flags=re.S)
    text = re.sub(r"\btable(\d+)\b(?!_)", lambda m, whole=text: _source(whole, m, mark), text)
    text = re.sub(r"'(\d+)'", lambda m: said[int(m[1])], text)
    out = spark.sql(text, args=args) if args else spark.sql(text)
    return out.toDF(*header(out.columns))


def _is_source(text: str, m: re.Match) -> bool:
    """Whether a name stands where a table is read (after FROM, JOIN or a comma
    of a FROM list), not before a dot."""
    before, after = text[: m.start()].rstrip(), text[m.end() :].lstrip()
    if after.startswith("."):
        return False
    return bool(re.search(r"(?:\bfrom|\bjoin)$", before, re.I) or re.search(r"\bfrom\s+table\d+(?:\s+(?:as\s+)?\w+)?(?:\s*,\s*table\d+(?:\s+(?:as\s+)?\w+)?)*\s*,$", before, re.I))


def _source(text: str, m: re.Match, mark: str) -> str:
    if not _is_source(text, m):
        return m[0]
    after = text[m.end() :].lstrip()
    named = re.match(r"(?:as\s+)?([A-Za-z_]\w*)", after, re.I)
    words = {"where", "group", "order", "limit", "join", "left", "right", "full", "inner", "cross", "natural", "on", "using", "union", "intersect", "except", "having", "window", "semi", "anti"}
    alias = named and named[1].lower() not in words
    return f"table{m[1]}_{mark}" + ("" if alias else f" AS table{m[1]}")
