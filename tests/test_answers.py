"""Each distinct prompt is asked once, answers outlive a run, and failures are rows."""

from strandlake.operators import models


def counted(log, flaky=False):
    """A model that logs every prompt it answers; flaky: the first call of a worker fails, and bad prompts always do."""

    def factory():
        calls = []

        def answer(prompts):
            calls.append(len(prompts))
            if flaky and len(calls) == 1:
                raise TimeoutError("too many requests")
            if flaky and any("bad" in p for p in prompts):
                raise ValueError("bad prompt")
            with open(log, "a") as f:
                f.writelines(p.replace("\n", " ") + "\n" for p in prompts)
            return [p.upper() for p in prompts]

        return answer

    return factory


def test_calls_equal_distinct_prompts(spark, tmp_path):
    log, cache = tmp_path / "log", f"file://{tmp_path}/answers"
    models.register("counted", counted(str(log)))
    rows = [(n, ["a", "b", "c", "", None][n % 5]) for n in range(200)]
    df = spark.createDataFrame(rows, "n long, p string").repartition(4)
    out = models.ask_once(df, "p", "counted", cache)
    assert out.columns == ["n", "p", "answer", "answer_error"]
    assert {(r.n, r.answer, r.answer_error) for r in out.collect()} == {(n, (p or "").upper(), None) for n, p in rows}
    out.count()  # looking again asks nothing
    assert sorted(log.read_text().splitlines()) == ["", "a", "b", "c"]
    more = spark.createDataFrame([(1, "a"), (2, "d")], "n long, p string")
    assert {(r.n, r.answer) for r in models.ask_once(more, "p", "counted", cache).collect()} == {(1, "A"), (2, "D")}
    assert sorted(log.read_text().splitlines()) == ["", "a", "b", "c", "d"]
    models.register("other", counted(str(log)))
    models.ask_once(more, "p", "other", cache)
    assert len(log.read_text().splitlines()) == 7  # another model has answers of its own


def test_failures_are_rows_and_asked_again(spark, tmp_path):
    log, cache = tmp_path / "log", f"file://{tmp_path}/answers"
    models.register("flaky", counted(str(log), flaky=True))
    df = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, "fine"), (4, "good")], "n long, p string").coalesce(1)
    got = {r.n: (r.answer, r.answer_error) for r in models.ask_once(df, "p", "flaky", cache, pause=0.01).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "ValueError: bad prompt"), 3: ("FINE", None), 4: ("GOOD", None)}
    models.register("flaky", counted(str(log)))  # it works now
    again = {r.n: (r.answer, r.answer_error) for r in models.ask_once(df, "p", "flaky", cache).collect()}
    assert again[2] == ("BAD ONE", None) and sorted(log.read_text().splitlines()) == ["bad one", "fine", "good"]


def test_pauses_between_calls(spark):
    calls = []
    assert models._tried(lambda p: calls.append(1) or ["x"], ["a", "b"], 2, 0.0) == [("x", None)] * 2  # wrong lengths are failures of the batch
    assert len(calls) == 4


def test_no_rows(spark):
    assert models.ask_once(spark.createDataFrame([], "p string"), "p").collect() == []
