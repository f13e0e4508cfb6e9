"""Records with everything that may go wrong: nulls in any column, empty and long texts, ties, repeats, clashing column names."""
