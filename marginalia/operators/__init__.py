"""Table-in, table-out steps of an audit."""
