from filigree.llm import neardup as N


def test_short_and_null_texts_get_a_row(spark):
    rows = [("a", "N/A"), ("b", "n a."), ("c", "a n"), ("d", None), ("e", None), ("f", "..."), ("g", "--"), ("h", "None."), ("i", "none"), ("i", "none")]
    rows += [("x", "one two three four five six"), ("y", "One two three, four five six!"), (None, "N/A")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: (r.group_id, r.n_links, r.group_size) for r in N.near_duplicate_groups(df, "id").collect()}
    assert got == {
        "a": ("a", 0, 2), "b": ("a", 0, 2), "c": ("c", 0, 1), "d": ("d", 0, 1), "e": ("e", 0, 1), "f": ("f", 0, 1), "g": ("g", 0, 1),
        "h": ("h", 0, 2), "i": ("h", 0, 2), "x": ("x", 0, 2), "y": ("x", 0, 2),
    }
