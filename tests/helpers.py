"""What several test modules use."""


def rows(df):
    """All rows as plain tuples, in a stable order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
