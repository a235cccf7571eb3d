"""Ready queries over the star-schema tables, and the SQL that they equal."""
