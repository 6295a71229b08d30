"""Readers and writers by format; ``read`` and ``write`` choose one."""

from .dispatch import read, register, write

__all__ = ["read", "register", "write"]
