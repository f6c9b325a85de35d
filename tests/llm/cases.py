"""Small documents with every awkward row: nulls, empty and long texts, ties, repeats, clashing names."""

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "row bigint, key string, d string, size double, name string, n int, spans string"
)
WORDS = "the quick brown fox jumps over one lazy dog while seven idle cats watch from a warm wall".split()


def sentence(i: int, n: int) -> str:
    return " ".join(f"{WORDS[(i * 7 + j * j + i * j) % len(WORDS)]}{(i * 31 + j * 17) % 97}" for j in range(n))


def texts() -> list[tuple]:
    """(doc_id, text, source)."""
    shared = sentence(500, 120)
    long = ". ".join(sentence(i, 11) for i in range(900)) + "."
    rows = [
        (1, "Hello World", "a"),
        (2, "hello world", "b"),
        (3, "HELLO WORLD", None),
        (4, "", "a"),
        (5, None, "b"),
        (None, "hello world", "b"),
        (None, None, None),
        (6, " \t\n ", "a"),
        (7, "one", "c"),
        (8, "one two", "c"),
        (9, long, "a"),
        (10, long + " and more", "a"),
        (11, "Größe çà ÄÖ é 漢字 \U0001f600", "c"),
        (12, "größe çà ÄÖ é 漢字 \U0001f600", "c"),
        (13, sentence(1, 60) + "\n" + shared + "\n" + sentence(2, 40), "b"),
        (14, sentence(3, 50) + "\n" + shared + "\n" + sentence(4, 30), "b"),
        (14, sentence(3, 50) + "\n" + shared + "\n" + sentence(4, 30), "b"),
        (15, "x" * 1500, "d"),
        (16, "ab" * 700 + "c" + "ab" * 300, "d"),
        (17, "a line\nb line\n\nc line\nlast", "e"),
        (18, "first\nb line\nc line\nlast\nb line\nc line", "e"),
    ]
    rows += [(100 + i, sentence(50 + i, 30), "hot") for i in range(20)]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, "en", s, None if t is None else len(t), 7, "k", "d", 0.5, "n", 3, "s") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
