"""The library's queries over the input tables, each with SQL for a second engine."""
