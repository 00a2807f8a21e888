"""What the tests share."""

SF = "/root/testdata/sf0.01"


def shown(df, *names):
    """Rows as sorted tuples, bytes as text."""
    return sorted(tuple(bytes(v).decode() if isinstance(v, (bytes, bytearray)) else v for v in r) for r in df.select(*names).collect())


def rows(df, *names):
    """Rows in an order of their own."""
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)
