"""Named queries over the tables of a directory, with the SQL that must give the same rows."""
