"""The driver's queries: two sides derived from orders, every operator over them, and SQL to hold them against."""
