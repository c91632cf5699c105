"""Small helpers for fixtures."""


def rows(df, *columns):
    """Sorted plain tuples; None sorts first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def one(df):
    return [r[0] for r in df.collect()]
