"""Documents with the cases that every operator must bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, score double, t string, k0 int"


def documents(spark, rows):
    """rows: (doc_id, text, source); the other columns have names that operators use inside."""
    full = [(i, t, "en", s, len(t) if t else 0, 7, 8, 0.5, "t", 1) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows():
    """Nulls in all columns, empty, blank, one word, very long, repeated rows, equal texts, odd characters."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    return [
        (1, "the quick brown fox jumps over the lazy dog again and again", "a"),
        (2, None, "a"),
        (3, "", "b"),
        (4, " \t\n\r\x0b\x0c", "b"),
        (5, "one", None),
        (None, "a text without an id", "a"),
        (None, None, None),
        (6, long_text, "c"),
        (7, "the quick brown fox jumps over the lazy dog again and again", "a"),
        (7, "the quick brown fox jumps over the lazy dog again and again", "a"),
        (8, "Ünïcode non-breaking space 漢字 🙂 ‍ end", ""),
        (9, "ONE", "B"),
        (10, "| a | b | c | " * 30, "c"),
    ]
