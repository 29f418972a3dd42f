"""The queries run by the driver: inputs shaped from its tables, and SQL that gives the same rows."""
