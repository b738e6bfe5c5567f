"""Plan shapes shared by several operators: top-k, ordered chunks, lineage cuts."""
