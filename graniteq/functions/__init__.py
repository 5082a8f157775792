"""Column expressions."""

from graniteq.functions.random_text import random_letters, random_letters_sql, random_long, random_long_sql

__all__ = ["random_letters", "random_letters_sql", "random_long", "random_long_sql"]
