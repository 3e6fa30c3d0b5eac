"""Views of the driver tables, registered queries and their SQL counterparts."""
