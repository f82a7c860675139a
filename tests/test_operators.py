"""Tables in, tables out: joins, samples, metrics, models, files, streams."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from veracity.operators import dedup, ingest, metrics, ml, quality, sampling, scoring
from veracity.sources import config, io
from veracity.sources.cache import AuditCache
from veracity.streaming import scoring as stream
from veracity.streaming.limiter import Limiter, admit, admit_stream

REC = "prompt string, answer string, label int, source string, variant_type string, _ord long"


def test_merge_keeps_current_duplicates(spark):
    cur = spark.createDataFrame([(1, "a", 1), (1, "a2", 2), (None, "n", 3)], "k int, v string, _ord int")
    new = spark.createDataFrame([(1, "x", 1), (2, "y2", 5), (2, "y", 2), (None, "m", 9)], "k int, v string, _ord int")
    assert sorted(r.v for r in dedup.merge_unique(cur, new, ["k"], "_ord").collect()) == ["a", "a2", "n", "y"]


def test_ring(spark):
    rows = [("p", "b", "B", 1), ("p", "a", "A", 2), ("p", "a", "C", 3), ("alone", "x", "X", 4), ("same", "q", "S", 5), ("same", "r", "S", 6)]
    got = {r.o: r.negative for r in dedup.ring_negatives(spark.createDataFrame(rows, "g string, q string, a string, o int"), "g", "q", "a", "o").collect()}
    assert got == {2: "C", 3: "B", 1: "A"}


def test_quality(spark):
    def pair(column, a, b):
        return spark.createDataFrame([(a, b)], "a string, b string").select(column(F.col("a"), F.col("b")).alias("x")).first().x

    assert pair(quality.supported_positive, "Столица Франции — Париж.", "Столица Франции — Париж, крупный город на Сене.")
    assert not pair(quality.supported_positive, "Париж.", "Париж.")
    assert pair(quality.drift_cheap, "Столица Франции — Париж.", "Столица Франции — Лондон, крупный город на реке.")
    rows = [
        ("Тирана?", "Тирана — столица Албании.", 0, "s", "positive", 1), ("Тирана?", "Тирана — столица Албания.", 1, "s", "groq_negative", 2),
        ("Париж?", "Столица — Париж.", 0, "s", "positive", 3), ("Париж?", "Столица — Руан.", 1, "s", "groq_negative", 4), ("нет", "x y", 1, "s", "groq_negative", 5),
    ]
    assert sorted(r._ord for r in quality.filter_negatives(spark.createDataFrame(rows, REC)).collect()) == [1, 3, 4, 5]
    got = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string").select(quality.sequence_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in got] == [difflib.SequenceMatcher(None, *x).ratio() for x in (("tide", "diet"), ("diet", "tide"))]


def test_reference_is_last(spark):
    rows = [("p", "one", 0, "s", "positive", 1), ("p", "two", 0, "s", "positive", 2), ("p", "three", 1, "s", "positive", 3), ("q", "only", None, "s", None, 4)]
    assert [(r.prompt, r.reference) for r in quality.reference_answers(spark.createDataFrame(rows, REC)).collect()] == [("p", "two")]


def test_samples(spark):
    rows = [(f"p{i}", f"a{i}", i % 2, "s", f"v{i}", i) for i in range(6)]
    df = spark.createDataFrame(rows, REC)
    got = sampling.stratified_sample(df, 4).collect()
    assert len({r.variant_type for r in got}) == 4 and got == sampling.stratified_sample(df, 4).collect() and sampling.stratified_sample(df, 6).count() == 6
    bench = spark.createDataFrame([(f"q{i}", f"a{i}", i % 2) for i in range(10)], "prompt string, model_answer string, is_hallucination int")
    assert sorted(r.is_hallucination for r in sampling.dev_slice(bench, 4).collect()) == [0, 0, 1, 1]
    assert sampling.dev_slice(bench.drop("is_hallucination"), 3).count() == 3
    typed = spark.createDataFrame([("кто это", "a", 0), ("когда это", "b", 1), ("где это", "c", 0), ("сколько", "d", 1), ("plain", "e", 0), ("other", "f", 1)], bench.schema)
    assert sampling.typed_dev_slice(typed, 4).where("prompt not in ('plain', 'other')").count() >= 3
    assert sampling.typed_dev_slice(bench, 4).count() == 4 and sampling.typed_dev_slice(typed.where("prompt not in ('plain', 'other')"), 9).count() >= 3
    five = spark.createDataFrame([(p, "a", 0, "s", "positive", i) for i, p in enumerate(("plain", "кто", "когда", "где", "сколько"))], REC)
    assert [r.prompt for r in sampling.round_robin(five, 5).collect()] == ["plain", "кто", "когда", "где", "сколько"]
    assert sampling.round_robin(five.limit(0), 5).count() == 0


def test_average_precision(spark):
    rng = random.Random(1)
    for n in (0, 7, 300):
        rows = [(rng.randint(0, 20) / 20, rng.randint(0, 1)) for _ in range(n)]
        found = metrics.average_precision(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()[0]
        total, tp, seen = sum(y for _, y in rows), 0, 0
        want = 0.0
        for t in sorted({s for s, _ in rows}, reverse=True):
            own = [y for s, y in rows if s == t]
            tp, seen = tp + sum(own), seen + len(own)
            want += sum(own) / total * tp / seen if total else 0
        assert found == pytest.approx(want)


def test_weights(spark):
    df = spark.createDataFrame([("groq_drift_negative", 1), ("positive", 0), ("groq_supported_positive", 0), (None, 0)], "variant_type string, label int")
    w = [r.weight for r in metrics.normalised_weights(df).collect()]
    assert sum(w) / 4 == pytest.approx(1) and metrics.normalised_weights(df.limit(0)).count() == 0
    strata = spark.createDataFrame([("positive", 0), ("positive", 0), ("groq_negative", 1), ("rare", 1)], "variant_type string, label int")
    assert sorted(r.stratum for r in metrics.stratify_labels(strata).collect()) == ["1", "1", "positive__0", "positive__0"]


def test_latency_of_nothing(spark):
    assert metrics.latency_summary(spark.createDataFrame([], "v double"), "v").first().asDict() == {"mean": 0.0, "p50": 0.0, "p95": 0.0, "p99": 0.0}


def test_models(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.gauss(i % 2, 0.7) for _ in range(16)] + [1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "_ord long, label int, features array<double>")
    split = sampling.stratified_split(df, "label", F.col("_ord")).cache()
    train, held = split.where("not is_validation"), split.where("is_validation")
    for kind in ("none", "isotonic", "sigmoid"):
        model = ml.fit(train, held, calibration=kind, max_iter=50)
        scored = model.predict(held)
        rows_ = scored.orderBy("margin").select("proba").collect()
        assert all(0 <= r.proba <= 1 for r in rows_) and all(a.proba <= b.proba + 1e-9 for a, b in zip(rows_, rows_[1:]))
        assert metrics.average_precision(scored, "proba", "label").first()[0] > 0.9
        model.save(f"{tmp_path}/{kind}")
        again = ml.Classifier.load(spark, f"{tmp_path}/{kind}").predict(held)
        assert scored.join(again.select("_ord", F.col("proba").alias("p2")), "_ord").where("abs(proba - p2) > 1e-9").count() == 0
    assert ml.fit(train, held.where("label = 1"), max_iter=20).calibration == "none"


def test_scoring_paths(spark):
    pairs = spark.createDataFrame([("q one?", "a"), ("q two?", "b"), (None, None)], "prompt string, answer string")

    def verifier(df):
        return df.withColumns({"raw": F.when(F.col("prompt") == "q one?", '{"h": 1}'), "status": F.lit("http_429"), "t_model_sec": F.lit(0.1)})

    got = {r.prompt: r for r in scoring.score(pairs, verifier=verifier).collect()}
    assert got["q one?"].is_hallucination_proba == 0.5 and got["q one?"].pred_is_hallucination
    assert got["q two?"].audit.status == "http_429" and 0 <= got["q two?"].is_hallucination_proba <= 1
    slow = scoring.score(pairs, verifier=lambda d: verifier(d).withColumn("t_model_sec", F.lit(9.0))).collect()
    assert all(r.is_hallucination_proba != 0.5 for r in slow)
    assert all(r.audit.status == "disabled" for r in scoring.score(pairs).collect())


def test_cache(spark, tmp_path):
    cache = AuditCache(spark, str(tmp_path / "c"))
    assert cache.read().count() == 0
    cache.put(spark.createDataFrame([("a", "1", 1.0), ("a", "2", 2.0), ("b", "3", 1.0)], io.CACHE))
    cache.put(spark.createDataFrame([("b", "4", 5.0)], io.CACHE))
    assert {(r.key, r.value) for r in cache.read().collect()} == {("a", "2"), ("b", "4")}


def test_files(spark, tmp_path):
    rows = [("prompt\n\"q\"", " a,b ", 1), ("п", None, None)]
    df = spark.createDataFrame(rows, io.BENCH)
    io.write_csv(df, str(tmp_path / "csv"))
    assert sorted(r.prompt for r in io.read_csv(spark, str(tmp_path / "csv")).collect()) == sorted(r[0] for r in rows)
    io.write_jsonl(df, str(tmp_path / "j"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert '"model_answer":null' in text and "п" in text
    assert io.read_jsonl_or_empty(spark, str(tmp_path / "absent"), io.SEED).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"prompt": "a"}\n\nnope\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), io.SEED).collect()


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("HELD", "old")
    (tmp_path / "e").write_text("# c\nexport A1_X='v 1'\nB1_X=\"w\"\nHELD=new\nnoise\n")
    assert config.load_env(str(tmp_path / "e")) == {"A1_X": "v 1", "B1_X": "w"}
    for k in ("A1_X", "B1_X"):
        monkeypatch.delenv(k)
    (tmp_path / "y").write_text("total_timeout_sec: 0.9\ntarget_rpm: 5\ntarget_tpm: 700\nprovider: x\nruntime_model: m-1\ntemperature: 0.0\n")
    s = config.ApiSettings.from_yaml(str(tmp_path / "y"))
    assert (s.total_timeout, s.requests_per_minute, s.tokens_per_minute, s.max_retries, s.runtime_model) == (0.9, 5, 700, 1, "m-1")
    (tmp_path / "n").write_text("nested:\n  a: 1\nb: true\n")
    assert config.load_yaml(str(tmp_path / "n")) == {"nested": {"a": 1}, "b": True}
    with pytest.raises(TypeError, match="unknown settings: nested"):
        (tmp_path / "u").write_text("nested: 1\n")
        config.ApiSettings.from_yaml(str(tmp_path / "u"))
    (tmp_path / "l").write_text("- a\n- b\n")
    with pytest.raises(TypeError):
        config.load_yaml(str(tmp_path / "l"))


def test_limiter(spark, tmp_path):
    x = Limiter(2, 100)
    assert [x.reserve(0, 10), x.reserve(1, 10), x.reserve(2, 10)] == [0.0, 0.0, 58.0]
    assert x.reserve(59.999, 10) > 0 and x.reserve(60.0, 10) == 0.0
    y = Limiter(9, 100)
    assert y.reserve(0, 500) == 0.0 and y.reserve(1, 10) == 59.0 and y.reserve(1, 200) == 60.0
    rows = [("k", float(i * 7), 30) for i in range(20)] + [("l", float(i), 1) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, ts double, tokens long")
    one, want = Limiter(3, 70), []
    for k, ts, n in rows[:20]:
        want.append(one.reserve(ts, n))
    assert [r.delay for r in admit(df, 3, 70).where("key = 'k'").orderBy("ts").collect()] == want
    df.coalesce(1).write.json(str(tmp_path / "in"))
    s = admit_stream(spark.readStream.schema(df.schema).json(str(tmp_path / "in")), 3, 70)
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.delay for r in spark.read.parquet(str(tmp_path / "out")).where("key = 'k'").orderBy("ts").collect()] == want


def test_stream_scores(spark, tmp_path):
    df = spark.createDataFrame([("кто это?", "Анна."), ("когда?", "вчера")], "prompt string, answer string")
    df.write.json(str(tmp_path / "in"))
    stream.start(spark.readStream.schema(df.schema).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = {r.prompt: r.is_hallucination_proba for r in scoring.score(df).collect()}
    assert {r.prompt: r.is_hallucination_proba for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_harvest(spark):
    rows = [("country_capital", {"countryLabel": " Франция ", "capitalLabel": "Париж"}, 1), ("country_capital", {"countryLabel": "Франция", "capitalLabel": "Лион"}, 2), ("country_capital", {"countryLabel": "", "capitalLabel": "X"}, 3), ("person_birth_year", {"personLabel": "Анна Каренина", "dob": "1879-03-14"}, 4), ("person_birth_year", {"personLabel": "Никто Такой", "dob": "когда-то"}, 5)]
    got = ingest.harvest(spark.createDataFrame(rows, "spec string, binding map<string,string>, _ord long"), 5).orderBy("_ord").collect()
    assert [r.answer for r in got] == ["Столица Франция — Париж.", "Анна Каренина родился в 1879 году."]


def test_cli(spark, tmp_path, capsys):
    from veracity.plans import cli

    seeds = spark.createDataFrame([(f"Когда случилось событие {i}?", f"Событие случилось в {1900 + i} году.", "year", "s") for i in range(40)], io.SEED)
    io.write_jsonl(seeds, str(tmp_path / "seeds"))
    cli.main(["build", "--stage", "rule-negatives", "--seed-path", str(tmp_path / "seeds"), "--output-path", str(tmp_path / "rec")])
    cli.main(["train", "--dataset-path", str(tmp_path / "rec"), "--model-dir", str(tmp_path / "m")])
    bench = seeds.select("prompt", F.col("answer").alias("model_answer"), (F.length("answer") % 2).alias("is_hallucination"))
    io.write_csv(bench, str(tmp_path / "b"))
    for _ in range(2):
        cli.main(["evaluate", "--csv-path", str(tmp_path / "b"), "--output-path", str(tmp_path / "o"), "--resume-from-checkpoint"])
    assert "'rows': 40" in capsys.readouterr().out
    cli.main(["estimate", "--seed-path", str(tmp_path / "seeds")])


def test_verifier(spark):
    from veracity.operators import verifier
    from veracity.sources.config import ApiSettings

    def call(prompt, answer):
        if prompt == "late":
            raise TimeoutError
        if prompt == "busy":
            raise verifier.HttpError(429)
        if prompt == "down":
            raise ConnectionError
        return 'well: {"h": 1}' if prompt == "good" else "nonsense"

    pairs = spark.createDataFrame([(p, "a") for p in ("good", "late", "busy", "down", "bad")], "prompt string, answer string")
    got = {r.prompt: r for r in scoring.audits(pairs, None, verifier.calling(call, ApiSettings(requests_per_minute=50))).collect()}
    assert {p: r.audit.status for p, r in got.items()} == {"good": "partial_json", "late": "timeout", "busy": "http_429", "down": "connection_error", "bad": "invalid_json"}
    limited = scoring.audits(pairs, None, verifier.calling(call, ApiSettings(requests_per_minute=2))).collect()
    assert sum(r.audit.status == "local_rate_limited" for r in limited) == 3
    assert all(r.audit.status == "missing_api_key" for r in scoring.audits(pairs, None, verifier.calling(call, ApiSettings(), has_key=False)).collect())


def test_augment(spark):
    rows = [(f"Столица страны {i}?", f"Столица страны {i} — Париж.", 0, "s", "positive", i) for i in range(6)]

    def rewrite(df, mode):
        if mode == "supported_positive":
            return df.withColumn("rewritten", F.concat(F.expr("left(answer, length(answer) - 1)"), F.lit(", крупный город на реке.")))
        return df.withColumn("rewritten", F.concat(F.replace("answer", F.lit("Париж."), F.lit("Лондон, крупный город на реке."))))

    got = ingest.augment(spark.createDataFrame(rows, REC), rewrite, 3).groupBy("variant_type").count().collect()
    assert {r.variant_type: r["count"] for r in got} == {"positive": 6, "groq_supported_positive": 3, "groq_drift_negative": 3}


def test_model_negatives_are_quota_and_budget(spark):
    rows = [(f"Столица страны {i}?", f"Столица страны {i} — Париж.", "s", i) for i in range(40)]
    seeds = spark.createDataFrame(rows, "prompt string, answer string, source string, _ord long")

    def rewrite(df, mode):
        assert mode == "negative"
        return df.withColumn("rewritten", F.when(F.col("_ord") % 3 == 0, F.replace("answer", F.lit("Париж"), F.lit("Лондон"))).when(F.col("_ord") % 3 == 1, F.col("answer")).otherwise(F.concat("answer", F.lit(" и ещё очень много других слов про этот город"))))

    got = ingest.model_negatives(seeds, rewrite, 5).orderBy("_ord").collect()
    assert [r._ord for r in got] == [0, 3, 6, 9, 12] and {(r.label, r.variant_type) for r in got} == {(1, "groq_negative")}
    assert [r._ord for r in ingest.model_negatives(seeds, rewrite, 20).orderBy("_ord").collect()] == list(range(0, 40, 3))
    assert ingest.model_negatives(seeds, rewrite, 9).count() == 9 and ingest.model_negatives(seeds, rewrite).count() == 14
    known = ingest.model_negatives(seeds, rewrite, 2)
    assert [r._ord for r in ingest.model_negatives(seeds, rewrite, 3, known).orderBy("_ord").collect()] == [6, 9, 12]
    # 25 seeds are tried at least, four for each wanted beyond that
    assert ingest.model_negatives(seeds.withColumn("_ord", F.col("_ord") * 3 + 1), rewrite, 5).count() == 0


def test_answers_are_written_back(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def verifier(df):
        def run(batches):
            for pdf in batches:
                asked.add(len(pdf))
                raw = pdf["prompt"].map({"good": '{"h": 1}', "odd": "no json"}.get)
                yield pdf.assign(raw=raw.where(raw.notna(), None), status=raw.isna().map({True: "timeout", False: "ok"}), t_model_sec=0.1)

        return df.mapInPandas(run, "key string, prompt string, answer string, raw string, status string, t_model_sec double")

    pairs = spark.createDataFrame([("good", "a"), ("good", "a"), ("odd", "a"), ("late", "a")], "prompt string, answer string")
    cache = AuditCache(spark, str(tmp_path / "c"))
    for n in (3, 4, 5):  # what timed out is asked again, the rest never
        found = scoring.audits(pairs, cache, verifier)
        rows = found.collect()
        assert found.count() == 4 and asked.value == n and cache.read().count() == 2
        assert {(r.prompt, r.audit.status, r.cached) for r in rows} == {("good", "partial_json", n > 3), ("odd", "invalid_json", n > 3), ("late", "timeout", False)}


def test_connectors(spark):
    import json
    import urllib.parse

    from veracity.sources import connect

    calls = []

    def base(url, headers, seconds):
        calls.append(urllib.parse.parse_qs(url.partition("?")[2])["query"][0])
        if "wd:Q571;" in calls[-1]:
            raise OSError("gone")
        subject, value = (w[1:] for w in calls[-1].split()[1:3])
        yield json.dumps({"results": {"bindings": [{subject: {"value": "Имя Кого-то"}, value: {"value": "1879-03-14" if value in ("dob", "dod") else "Значение"}}]}})

    found = connect.bindings(spark, opener=base, per_spec=45)
    assert len(calls) == 8 and all(q.endswith("LIMIT 45") for q in calls) and found.count() == 7
    seeds = {r.source: r.answer for r in ingest.harvest(found, 5).collect()}
    assert len(seeds) == 7 and seeds["wikidata:person_birth_year"] == "Имя Кого-то родился в 1879 году." and "wikidata:book_author" not in seeds
    rows = connect.popqa(spark, "u", opener=lambda *_: iter(["id\tquestion\tpossible_answers\tprop", '1\tКто?\t"[""А"", ""Б""]"\tauthor', "2\tКто это?\t[]\t"]))
    assert [(r.question, r.possible_answers, r.prop) for r in rows.orderBy("_ord").collect()] == [("Кто?", '["А", "Б"]', "author"), ("Кто это?", "[]", "")]
    read = []

    def lines(*_):
        for i in range(1000):
            read.append(i)
            yield json.dumps({"claim": f" c{i // 2}", "label": ("SUPPORTS", "SUPPORTS", "OTHER")[i % 3]}) if i % 5 else ""

    got = connect.claims(spark, "u", 10, opener=lines)
    assert len(read) < 40 and ingest.fever(got, 10).count() == 10


def test_ring_over_many_parts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), f"q{rng.randint(0, 400)}", f"x{rng.randint(0, 30)}", i) for i in range(900)]
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[3]))
        want |= {r[3]: own[(i + 1) % len(own)][2] for i, r in enumerate(own) if len(own) > 1 and own[(i + 1) % len(own)][2] != r[2]}
    df = spark.createDataFrame(rows, "g string, q string, a string, o int")
    got = dedup.ring_negatives(df, "g", "q", "a", "o")
    assert got.columns == ["g", "q", "a", "o", "negative"] and {r.o: r.negative for r in got.collect()} == want
    assert dedup.ring_negatives(df.limit(0), "g", "q", "a", "o").count() == 0


def test_percentiles(spark):
    import numpy as np

    rng = random.Random(5)
    rows = [(g, v) for g, n in (("a", 1), ("b", 2), ("c", 301), ("d", 40), (None, 7)) for v in [rng.choice([rng.gauss(0, 1), 3.0, 1e6]) if g != "d" else 2.5 for _ in range(n)]] + [("e", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in metrics.latency_summary(df, "v", ["g"], bins=16).collect():
        own = [v for g, v in rows if g == r.g and v is not None]
        assert [r.mean, r.p50, r.p95, r.p99] == pytest.approx([np.mean(own), *np.percentile(own, [50, 95, 99])] if own else [0, 0, 0, 0])
    every = [v for _, v in rows if v is not None]
    assert list(metrics.latency_summary(df, "v").first()) == pytest.approx([np.mean(every), *np.percentile(every, [50, 95, 99])])


def test_splits_are_exact(spark):
    rows = [(i, "abc"[min(i % 7, 2)] if i else None) for i in range(203)]
    df = spark.createDataFrame(rows, "i long, s string")
    got = sampling.stratified_split(df, "s", F.col("i"))
    n = {r.s: (r.n, r.v) for r in got.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.col("is_validation").cast("int")).alias("v")).collect()}
    assert sum(v for _, v in n.values()) == 41 and all(abs(v - 41 * m / 203) < 1 for m, v in n.values())
    assert got.collect() == sampling.stratified_split(df, "s", F.col("i")).collect()
    assert sampling.random_split(df, F.col("i")).where("is_test").count() == 203 - round(0.7 * 203)
    assert sampling.stratified_split(df.limit(0), "s", F.col("i")).count() == 0 == sampling.random_split(df.limit(0), F.col("i")).count()


def test_ranks_in_bins(spark):
    from veracity.functions import text as T

    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("g")).withColumn("k", T.key_digest(F.col("id")))
    rows = sorted((r.g, r.k, r.id) for r in df.collect())
    for k in (2, 1200):
        got = {r.id: r._rn for r in sampling.top_by(df, F.col("g"), "k", k).collect()}
        assert got == {i: n for n, (_, _, i) in ((sum(a[0] == x[0] and a[1] <= x[1] for a in rows[:0]) or j % 1000 + 1, x) for j, x in enumerate(rows)) if n <= k}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """No cross join, no exact percentile buffer, no window over a whole group."""
    df = spark.createDataFrame([("positive", 0, 1.0), ("x", 1, 2.0)], "variant_type string, label int, v double")
    assert "CartesianProduct" not in plan(metrics.normalised_weights(df)) and "NestedLoopJoin" not in plan(metrics.normalised_weights(df))
    assert "percentile(" not in plan(metrics.latency_summary(df, "v", ["label"])) and "percentile(" not in plan(metrics.latency_summary(df, "v"))
    keyed = df.withColumn("k", F.sha2("variant_type", 256))
    assert "_bin" in plan(sampling.top_by(keyed, F.col("label"), "k", 5000)) and "WindowGroupLimit" in plan(sampling.top_by(keyed, F.col("label"), "k", 900))


def test_prompts(spark):
    from veracity.functions import text as T

    p, a = F.col("p"), F.col("a")
    row = spark.createDataFrame([("кто это?", "Анна.")], "p string, a string").select(T.augment_chat(p, a, True), T.augment_chat(p, a, False), T.mutate_chat(p, a), T.audit_instruction(p)).first()
    good, bad, plain, told = row
    assert [m.role for m in good] == ["system", "user"] == [m.role for m in bad] == [m.role for m in plain]
    assert good[0].content.endswith(T.HINTS["who"][0]) and bad[0].content.endswith(T.HINTS["who"][1]) and told == T.INSTRUCTIONS["who"]
    assert good[1].content == "Question: кто это?\nReference answer: Анна.\nReturn only the rewritten factual answer." and "Анна." in plain[1].content


def test_cli_stages(spark, tmp_path):
    from veracity.plans import cli

    seeds = spark.createDataFrame([(f"Какая столица у страны {i}?", f"Столица страны {i} — Париж.", "place", "s") for i in range(12)], io.SEED)
    io.write_jsonl(seeds, str(tmp_path / "seeds"))
    at = lambda n: str(tmp_path / n)
    long = lambda town, place: F.concat(F.expr("replace(answer, 'Париж.', '')"), F.lit(f"{town}, крупный город на {place}."))
    given = [seeds.select("prompt", "answer", F.lit(m).alias("mode"), e.alias("rewritten")) for m, e in (("negative", F.replace("answer", F.lit("Париж"), F.lit("Лондон"))), ("supported_positive", long("Париж", "реке")), ("drift_negative", long("Лондон", "море")))]
    io.write_jsonl(given[0].unionByName(given[1]).unionByName(given[2]), at("rewrites"))
    count = lambda n: {r.variant_type: r["count"] for r in io.read_jsonl(spark, at(n), io.RECORD).groupBy("variant_type").count().collect()}
    cli.main(["build", "--stage", "groq-negatives", "--seed-path", at("seeds"), "--rewrites-path", at("rewrites"), "--output-path", at("a"), "--limit", "5"])
    assert count("a") == {"positive": 12, "rule_negative": 12, "groq_negative": 5}
    cli.main(["build", "--stage", "targeted-augment", "--dataset-path", at("a"), "--rewrites-path", at("rewrites"), "--output-path", at("b"), "--limit", "3"])
    assert count("b") == {"positive": 12, "rule_negative": 12, "groq_negative": 5, "groq_supported_positive": 3, "groq_drift_negative": 3}
    cli.main(["build", "--stage", "seed", "--seed-path", at("seeds"), "--output-path", at("c")])
    assert count("c") == {"positive": 12}
    cli.main(["external", "--seed-path", at("seeds"), "--main-seed-path", at("absent"), "--main-path", at("c"), "--output-path", at("d"), "--seed-output-path", at("e")])
    assert count("d") == {"positive": 12} and io.read_jsonl(spark, at("e"), io.SEED).count() == 12
    found = spark.createDataFrame([("country_capital", {"countryLabel": c, "capitalLabel": "Город"}) for c in ("Франция", "Испания", "Чили")], io.BINDING)
    io.write_jsonl(found, at("bindings"))
    io.write_jsonl(spark.createDataFrame([("Как называется столица Чили?", "Столица Чили — Сантьяго.", "place", "own")], io.SEED), at("known"))
    cli.main(["build", "--stage", "seed-harvest", "--seed-path", at("bindings"), "--resume-path", at("known"), "--output-path", at("f")])
    assert sorted(r.answer for r in io.read_jsonl(spark, at("f"), io.SEED).collect()) == ["Столица Испания — Город.", "Столица Франция — Город.", "Столица Чили — Сантьяго."]
    bench = seeds.select("prompt", F.col("answer").alias("model_answer"), F.lit(1).alias("is_hallucination"))
    io.write_csv(bench, at("bench"))
    cli.main(["evaluate", "--csv-path", at("bench"), "--output-path", at("scored"), "--checkpoint-every", "5"])
    assert spark.read.parquet(at("scored")).count() == 12


SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def plain(spark):
    """The records of the tables, and the token sets of a text, restated."""
    import re

    from veracity.functions import lexicon as L
    from veracity.plans import catalogue

    def stem(w):
        w = w.lower()
        for s in L.SUFFIXES_BUILDING if len(w) > 4 else ():
            if w.endswith(s) and len(w) - len(s) >= 4:
                return w[: -len(s)]
        return w

    words = lambda t: re.findall(r"\b[\w\-]+\b", t)
    salient = lambda t: {stem(w) for w in words(t) if len(w) > 1 and w.lower() not in L.NOISE_TOKENS}
    numbers = lambda t: {x.replace(",", ".") for x in re.findall(r"\b\d+(?:[.,]\d+)?\b", t)}
    symbols = lambda t: set(re.findall(r"\b[A-Z][A-Za-z0-9]{0,4}\b", t))
    joined = lambda t: " ".join(map(stem, words(t)))
    same = lambda a, b: salient(a) == salient(b) and numbers(a) == numbers(b) and symbols(a) == symbols(b)
    return catalogue.records(spark, SF).orderBy("_ord").collect(), salient, numbers, symbols, joined, same


@needs_tables
def test_quality_ratio_query(spark, plain):
    from veracity.plans import catalogue

    rows, salient, numbers, _, joined, same = plain
    refs = {r.prompt: r.answer for r in rows if r.label == 0}

    def stays(r):
        ref = refs.get(r.prompt, "")
        if r.variant_type != "groq_negative" or not ref:
            return True
        n, m = len(ref.split()), len(r.answer.split())
        if m < 2 or m > max(14, int(n * 1.45) + 2) or joined(ref) == joined(r.answer) or same(ref, r.answer) or (r.answer.count(",") > ref.count(",") + 1 and m > n + 6):
            return False
        ratio = difflib.SequenceMatcher(None, joined(ref), joined(r.answer)).ratio()
        return not (ratio >= 0.96 and numbers(ref) == numbers(r.answer) and len(salient(ref) ^ salient(r.answer)) <= 1)

    assert {r._ord for r in catalogue.quality_ratio(spark, SF).collect()} == {r._ord for r in rows if stays(r)}


@needs_tables
def test_quality_augmented_query(spark, plain):
    from veracity.plans import catalogue

    rows, salient, numbers, symbols, joined, same = plain
    refs = {r.prompt: r.answer for r in rows if r.label == 0 and r.variant_type != "groq_supported_positive"}

    def stays(r):
        ref, new = refs.get(r.prompt, ""), r.answer
        if not ref or r.variant_type not in ("groq_supported_positive", "groq_drift_negative"):
            return True
        n, m, ends = len(ref.split()), len(new.split()), new.strip().endswith((".", "!", "?"))
        if r.variant_type == "groq_supported_positive":
            kept = not salient(ref) or len(salient(ref) & salient(new)) / len(salient(ref)) >= 0.6
            return bool(new.strip() and ref.strip() != new.strip() and n + 2 < m <= max(22, int(n * 2.6) + 8) and kept and numbers(ref) <= numbers(new) and symbols(ref) <= symbols(new) and ("," in new or "." in new) and ends)
        flat = new.count(",") == 0 and new.count(".") <= ref.count(".")
        fits = max(4, n + 2) <= m <= max(28, int(n * 3.0) + 12) and joined(ref) != joined(new) and not same(ref, new) and not flat and ends and salient(new) - salient(ref)
        return bool(fits) and difflib.SequenceMatcher(None, joined(ref), joined(new)).ratio() < 0.985

    assert {r._ord for r in catalogue.quality_augmented(spark, SF).collect()} == {r._ord for r in rows if stays(r)}


@needs_tables
@pytest.mark.parametrize("name", ["lr_scores", "isotonic_scores", "sigmoid_scores"])
def test_score_queries(spark, name):
    """A fitted model is a fixed point: probabilities rise with the margin, the mean of the training rows' weighted residuals is nil,
    and an isotonic calibrator has the pooled means of the validation rows."""
    from veracity.plans import catalogue

    rows = catalogue.QUERIES[name](spark, SF).collect()
    plainly = {r._ord: r.proba for r in catalogue.QUERIES["lr_scores"](spark, SF).collect()}
    assert rows and all(0 <= r.proba <= 1 for r in rows) and len({r._ord for r in rows}) == len(rows)
    by = sorted((plainly[r._ord], r.proba) for r in rows)
    assert all(a[1] <= b[1] + 1e-5 for a, b in zip(by, by[1:]) if b[0] - a[0] > 1e-5)
    if name == "lr_scores":
        weights = {r._ord: r.weight for r in catalogue.metrics.normalised_weights(catalogue.records(spark, SF)).collect()}
        train = [r for r in rows if not r.is_validation]
        n = {y: sum(r.label == y for r in train) for y in (0, 1)}
        assert abs(sum(weights[r._ord] / n[r.label] * (r.label - r.proba) for r in train)) < 1e-3  # the intercept's condition
    if name == "isotonic_scores":
        held = [r for r in rows if r.is_validation]
        assert len({r.proba for r in held}) <= len(held) and sum(r.proba for r in held) == pytest.approx(sum(r.label for r in held), abs=0.35 * len(held))


@needs_tables
def test_selection_and_component_queries(spark):
    from veracity.plans import catalogue

    found = {r.variant: r for r in catalogue.variant_selection(spark, SF).collect()}
    best = max(found, key=lambda v: (found[v].average_precision, -int(v[1:])))
    assert set(found) == {"v1", "v2", "v3", "v4"} and [v for v in found if found[v].selected] == [best]
    for name in ("pca_lr", "probe_lr"):
        rows = catalogue.QUERIES[name](spark, SF).collect()
        good, bad = [r.proba for r in rows if r.label], [r.proba for r in rows if not r.label]
        assert len(rows) == 500 and all(0 <= r.proba <= 1 for r in rows)
        if good and bad:
            assert sum(a > b for a in good for b in bad) >= 0.45 * len(good) * len(bad)


@needs_tables
def test_components_are_numpys(spark):
    import numpy as np

    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = ml.centred_pca(df, "embedding", 4).collect()
    x = np.array([r.embedding for r in rows], float)
    x -= x.mean(0)
    own = x @ np.linalg.svd(x, full_matrices=False)[2][:4].T
    got = np.array([r.pca for r in rows])
    assert np.allclose(np.abs(got), np.abs(own), atol=1e-6)


@needs_tables
def test_quota_queries(spark):
    from veracity.plans import catalogue

    pairs = catalogue._qa_records(spark, SF).collect()
    made = catalogue.model_negatives(spark, SF).collect()
    assert len(made) <= 40 and len({(r.prompt, r.answer) for r in made}) == len(made) and {(r.label, r.variant_type) for r in made} <= {(1, "groq_negative")}
    assert {r.prompt for r in made} <= {r.prompt for r in pairs} and not {(r.prompt, r.answer) for r in made} & {(r.prompt, r.answer) for r in pairs}
    out = catalogue.targeted_augment(spark, SF).groupBy("variant_type").count().collect()
    n = {r.variant_type: r["count"] for r in out}
    assert n["positive"] == len(pairs) and all(n.get(v, 0) <= 20 for v in ("groq_supported_positive", "groq_drift_negative"))


def test_split_report(spark):
    df = spark.createDataFrame([(1, 0.9, 0.2), (1, 0.4, 0.1), (0, 0.6, 0.3), (0, 0.1, 2.0)], "label int, proba double, t double")
    got = ml.split_report(df, seconds="t")
    assert (got["rows"], got["positives"], got["accuracy"]) == (4, 2, 0.5) and got["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert got["p99"] == pytest.approx(0.3 + 0.97 * 1.7) and not got["in_time"] and ml.split_report(df.where("t < 1"), seconds="t")["in_time"]
