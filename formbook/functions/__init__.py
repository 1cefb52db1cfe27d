"""Pure ``Column`` builders: no DataFrame, no shuffle, no Python UDF."""
