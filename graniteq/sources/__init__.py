"""Tables, generated relations and block files."""

from graniteq.sources.blockfile import BlockFileSource, read_blocks, write_blocks
from graniteq.sources.generate import generate_pair, generate_relation, generate_relation_sql
from graniteq.sources.tables import table, table_exists

__all__ = ["BlockFileSource", "generate_pair", "generate_relation", "generate_relation_sql", "read_blocks", "table", "table_exists", "write_blocks"]
