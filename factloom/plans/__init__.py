"""Queries over the driver's tables, which play the roles of source-code facts, and the SQL that checks them."""
