"""Registered queries: each is a Spark plan over the driver tables and an independent SQL statement of the same rows."""
