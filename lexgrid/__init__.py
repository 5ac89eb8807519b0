"""lexgrid: full-text pattern matching over byte strings as Spark relations."""
