"""Where data comes from and goes to: schemas, CSV, tables, marts, star-table binding."""
