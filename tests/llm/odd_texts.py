"""Rows and paths that the tests of the training-text operators share."""

SF = "/root/testdata/sf0.001"

#: names that the operators use themselves
CLASHES = ["n_words", "kept", "fp", "root", "component_id", "shard", "slot", "size", "n_tokens", "rate", "host", "doc",
           "items", "runs", "row", "law", "family", "paragraph", "url", "day", "lang_pred", "p_good", "_w", "_key"]
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i % 7} gamma{i % 11}" for i in range(60))


def odd_rows():
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties,
    repeated rows, near copies, junk."""
    return [
        (5, BASE, "en", "a"), (5, BASE, "en", "a"), (9, BASE, "en", "b"), (7, BASE + " tail", None, "b"),
        (1, None, "en", "a"), (2, "", "de", None), (3, " \t\n\r ", None, None), (None, BASE, "en", "c"),
        (None, None, None, None), (12, LONG, "fr", "a"), (13, LONG[40:] + " end", "fr", "a"),
        (20, "one", "en", "a"), (21, "one two", "en", "a"), (22, "One TWO", "es", "a"),
        (30, "be " * 400, "en", "d"), (31, "BE  " * 400, "en", "d"),
        (40, "line of text here\n" * 30 + "#*$%&|<>", "en", "a"), (41, "é" * 60 + "É ß ñandú ǰ J̌́", "es", "a"),
        (42, "<|endoftext|> don't we'll #1 2.5 　x y", "en", "a"), (50, "\x00\x01 nul \x7f", "en", "a"),
        (60, BASE.upper(), "en", "a"), (61, "x" * 49, "en", "a"), (62, "x" * 50, "en", "a"), (63, "x" * 120, "en", "a"),
        (70, "Licensed under the Apache License, Version 2.0.\nother words", "en", "a"),
    ]
