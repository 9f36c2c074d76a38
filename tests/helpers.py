"""Names that several test modules share."""

SMALL = "/root/testdata/sf0.001"


def rows(df, *order):
    """Rows as plain tuples, sorted by the given columns."""
    return [tuple(r) for r in df.orderBy(*order).collect()]
