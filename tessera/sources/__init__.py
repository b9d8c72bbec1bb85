"""Reading and writing: bars, books, calendars, feather files, tables."""
