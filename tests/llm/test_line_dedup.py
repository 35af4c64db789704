from millrace.llm import line_dedup


def test_what_is_left_of_a_document_stays(spark):
    shared = "\n".join(f"a passage that stands on many sites, line {i}" for i in range(20))
    rows = [(i, shared, f"s{i}") for i in range(6)]
    rows += [(7, f"{shared}\nits own line", "s1"), (8, f"\t\n{shared}\n \n", "s2"), (9, None, "s3"), (10, "", "s4"), (11, "  ", "s5")]
    got = line_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.text for r in got} == {0: shared, 7: "its own line", 9: None, 10: "", 11: "  "}
