"""Named query plans and their SQL statements."""
