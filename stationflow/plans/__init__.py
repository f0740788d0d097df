"""The registered queries: operators bound to the test tables, with their SQL checks."""
