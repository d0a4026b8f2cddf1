def same_partition(a, b):
    """Two labelings group the same rows, whatever the label values."""
    there, back = {}, {}
    return all(there.setdefault(x, y) == y and back.setdefault(y, x) == x for x, y in zip(a, b))
