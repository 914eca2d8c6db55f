SF = "/root/testdata/sf0.001"


def edge_rows():
    """NULL and empty texts, NULL and repeated ids, repeated rows, one very long text."""
    return [(1, None), (2, ""), (3, " \n\t"), (None, "no id here"), (4, "same text twice"), (4, "same text twice"), (5, "x" * 300_000),
            (6, "A short line.\nAnd another line, with words."), (7, "A short line.\nAnd another line, with words."), (None, None), (8, "é ß 漢字 😀")]
