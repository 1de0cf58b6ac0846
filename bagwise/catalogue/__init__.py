"""Named queries over the benchmark tables, each with the SQL it must agree with where SQL can say it."""
