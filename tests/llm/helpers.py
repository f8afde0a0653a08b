"""Small document tables with the cases every operator has to stand."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, start int, score double"


def docs(spark, texts, langs=None):
    """Documents with extra columns whose names clash with those that operators make."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i], f"src{i % 3}", len(t or ""), 7, 8, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


ODD = [None, "", " ", "\n\t ", "a", "é", "a" * 3000, "x\x00y", "12 34", "same text here", "same text here", "<|endoftext|> it's I'LL", "\U0001f600 smile", "tab\tand\x0bvt  end  "]
