"""Column-level helpers: missing values, calendar, units, air physics, row-wise means, text."""
