"""Results as plain lists."""


def rows(df, *order):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
