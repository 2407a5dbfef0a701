"""The registered queries: each operator over the driver's tables, with the SQL that must agree."""
