"""The texts without their frequent lines."""

from runweave.llm import quality
from runweave.llm.common import prepare

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_cleaned_texts(spark):
    prepare(spark)
    rows = [(i, f"Page {i} of 30\n\n own line {chr(97 + i)}\nShare  THIS", "en", "s" if i % 2 else None, 0) for i in range(12)]
    rows += [(90, "share this", "en", "s", 0), (91, "share this\nrare", "en", "t", 0), (92, None, "en", "s", 0), (93, "", "en", None, 0), rows[3]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.text) for r in quality.cleaned(docs, most_docs=4, most_share=0.005).collect() if r.text is not None)
    # one digit and two digits are different lines; page 10 and 11 stand once in each host
    want = [(i, ("" if i < 10 else f"Page {i} of 30\n") + f"\n own line {chr(97 + i)}") for i in range(12)]
    assert got == sorted([*want, want[3], (90, ""), (91, "share this\nrare"), (93, "")])
    assert quality.cleaned(docs, 4).columns == docs.columns and quality.cleaned(docs, 4).count() == len(rows)
