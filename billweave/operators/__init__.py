"""DataFrame operators: layout, tables, fields, bills, scenarios, catalogue."""
