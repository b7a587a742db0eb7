"""Long runs of one kind of character: results come in linear time and without deep recursion."""

from clauseloom.llm import pii, secrets

N = 300_000
RUNS = {
    1: "a" * N, 2: "7" * N, 3: "." * N, 4: "Mr " + "Anna " * (N // 30), 5: "x a@b" + ".cc" * (N // 3), 6: "a1" * (N // 2), 7: "A" * N, 8: "Mr " + "van " * (N // 4), 9: "Mr A" + "-a" * (N // 2),
    10: "Mr " + "J." * (N // 2), 11: "password" + " " * N, 12: "a@" * (N // 2), 13: "Mr Jan Berg wrote to jan@berg.example.org",
}


def table(spark):
    return spark.createDataFrame(list(RUNS.items()), "doc_id long, text string").repartition(8)


def test_secrets(spark):
    got = {r.doc_id: r for r in secrets.find_secrets(table(spark)).collect()}
    assert len(got) == len(RUNS)
    assert all(r.n_assign == 0 and r.n_access == 0 for r in got.values())
    # Digits are hexadecimal; the long run is one span.
    assert got[2].n_hex == 1 and got[2].spans == f"hex:0:{N}"


def test_schemes_are_cut_to_31_characters(spark):
    near = "client_id=abcdef password=hunter22 "
    df = spark.createDataFrame([(1, near + "https://x.example.org"), (2, near + "x" * 40 + "://x.example.org")], "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",")[-1] for r in secrets.find_secrets(df).collect()}
    assert got == {1: f"endpoint:{len(near)}:{len(near) + 21}", 2: f"endpoint:{len(near) + 9}:{len(near) + 40 + 16}"}


def test_surrogates(spark):
    got = {r.doc_id: r for r in pii.pseudonymize(table(spark), "key").collect()}
    assert len(got) == len(RUNS)
    assert all(got[i].text == RUNS[i] and got[i].n_entities == 0 for i in (1, 2, 3, 6, 7, 8, 11, 12))
    assert "Anna" not in got[4].text and got[5].n_entities == 1 and "a@b" not in got[5].text
    assert got[13].n_entities == 2 and "Berg" not in got[13].text and "berg" not in got[13].text
