"""Rows that every operator has to take."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside.
CLASHES = ["node", "n", "key", "value", "length", "host", "component", "_text", "readable", "part", "spans", "added", "live_values", "row"]

AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (4, "word", "en", "s", 4),
    (5, "one two three four five six", "en", None, 27),
    (5, "one two three four five six", "en", None, 27),
    (None, "one two three four five six", None, "s", 27),
    (7, "ONE TWO THREE FOUR FIVE SIX", "en", "s", 27),
    (8, "1234 5678", "en", "s", 9),
    (9, "".join(f"w{i} " for i in range(30_000)), "en", "s", 180_000),
    (10, "été ß 漢字    x <|endoftext|>", "fr", "s", 20),
]
