"""The library run on the test tables, with the SQL each result has to equal."""
