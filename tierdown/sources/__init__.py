"""Where items come from: object listings, tables, text files, policies."""

from tierdown.sources.inventory import file_inventory, object_reader
from tierdown.sources.policies import POLICY_SCHEMA, read_policies
from tierdown.sources.readable import broken_streams, decompress_read, read_with_errors
from tierdown.sources.tables import event_stream, file_ages, table_source
from tierdown.sources.walk import walk_objects

__all__ = [
    "POLICY_SCHEMA",
    "broken_streams",
    "decompress_read",
    "event_stream",
    "file_ages",
    "file_inventory",
    "object_reader",
    "read_policies",
    "read_with_errors",
    "table_source",
    "walk_objects",
]
