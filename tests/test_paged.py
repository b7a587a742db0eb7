"""Paged sources: every record once, whatever fails in between."""

import json

import pytest

from clauseloom.sources import paged
from clauseloom.streaming.stateful import start

SCHEMA = "id long, name string, tags string"


def service(folder, fails: dict[int, int] | None = None):
    """Pages from files; page n fails fails[n] times, counted in files as tasks share no memory."""
    folder, fails = str(folder), fails or {}

    def fetch(page):
        import os

        for i in range(fails.get(page, 0)):
            if not os.path.exists(f"{folder}/failed-{page}-{i}"):
                open(f"{folder}/failed-{page}-{i}", "w").close()
                raise OSError(f"page {page}")
        path = f"{folder}/{page}.json"
        return json.load(open(path)) if os.path.exists(path) else []

    return fetch


def put(folder, pages):
    for n, ids in pages.items():
        (folder / f"{n}.json").write_text(json.dumps([{"id": i, "name": f"n{i}", "tags": ["é", {"a": i}], "more": 1} for i in ids]))


@pytest.mark.parametrize("readers, pages", [(1, 7), (3, 7), (8, 7), (4, 0), (2, 1)])
def test_a_batch_reads_every_page_once(spark, tmp_path, readers, pages):
    put(tmp_path, {n: range(10 * n, 10 * n + (10 if n < pages else 3)) for n in range(1, pages + 1)})
    got = paged.read_pages(spark, f"batch_{readers}_{pages}", service(tmp_path), SCHEMA, readers=readers).collect()
    assert sorted(r.id for r in got) == sorted(i for n in range(1, pages + 1) for i in range(10 * n, 10 * n + (10 if n < pages else 3)))
    assert all(r.name == f"n{r.id}" and json.loads(r.tags) == ["é", {"a": r.id}] for r in got)


def test_fields_that_lack_are_null_and_numbers_become_text(spark, tmp_path):
    (tmp_path / "1.json").write_text('[{"id": 1}, {"id": null, "name": 5, "tags": "x"}, {}]')
    got = paged.read_pages(spark, "lacking", service(tmp_path), SCHEMA, readers=2).collect()
    assert [tuple(r) for r in got] == [(1, None, None), (None, "5", "x"), (None, None, None)]


def test_a_page_is_tried_again_and_a_failing_one_fails_the_batch(spark, tmp_path):
    put(tmp_path, {1: [1], 2: [2], 3: [3]})
    assert paged.read_pages(spark, "again", service(tmp_path, {2: 2}), SCHEMA, readers=2, tries=3, wait=0).count() == 3
    with pytest.raises(Exception, match="page 3"):
        paged.read_pages(spark, "never", service(tmp_path, {3: 99}), SCHEMA, readers=2, tries=2, wait=0).count()


def run(spark, name, fetch, tmp_path, **how):
    stream = paged.stream_pages(spark, name, fetch, SCHEMA, tries=1, wait=0, **how)
    start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()


def ids(spark, tmp_path):
    return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_stream_resumes_after_a_failed_page_with_every_record_once(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    put(pages, {n: [2 * n, 2 * n + 1] for n in range(1, 6)})
    run(spark, "resumed", service(pages), tmp_path)
    assert ids(spark, tmp_path) == list(range(2, 10))  # the last page may still grow
    put(pages, {n: [2 * n, 2 * n + 1] for n in range(5, 10)})
    # Found by the driver, lost by the task, page 7 stops the run.
    flaky = service(pages, {7: 2})
    for _ in range(4):
        try:
            run(spark, "resumed", flaky, tmp_path)
            break
        except Exception as e:
            assert "page 7" in str(e)
    assert ids(spark, tmp_path) == list(range(2, 18))
    run(spark, "resumed", service(pages), tmp_path, last=True)
    assert ids(spark, tmp_path) == list(range(2, 20))
    run(spark, "resumed", service(pages), tmp_path, last=True)
    assert ids(spark, tmp_path) == list(range(2, 20))


def test_a_stream_deals_its_pages_to_so_many_tasks(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    for readers, end in ((3, 12), (20, 15), (2, 16)):
        put(pages, {n: [n] for n in range(1, end)})
        run(spark, "dealt", service(pages), tmp_path, readers=readers, last=True)
        assert ids(spark, tmp_path) == list(range(1, end))


def test_register_documents(spark):
    rows = [
        ("c1", "d1", "An Executive Order", "PRESDOCU", None, "2024-04-01T00:00", "u", "p", None), ("", "d2", "Other", "presdocu", None, "2024-04-30", "", "p", "14001"), (None, "d3", "OMB asks", "Notice", None, "2024-02-28", None, None, None),
        ("c4", "d4", "Memorandum", "NOTICE", None, "2024-02-27", "u", None, None), ("c5", "d5", "Proclamation", "PRESDOCU", None, "2024-04-01", "u", None, ""), ("c6", "d6", "Executive order", "RULE", None, "2024-04-01", "u", None, None), ("c7", "d7", None, None, "x", "never", "u", None, None),
    ]
    got = paged.register_documents(spark.createDataFrame(rows, paged.REGISTER), "2024-04-30").collect()
    assert {tuple(r) for r in got} == {("c1", "An Executive Order", "PRESDOCU", "2024-04-01", "u"), ("d2", "Other", "presdocu", "2024-04-30", "p"), ("d3", "OMB asks", "Notice", "2024-02-28", "")}
