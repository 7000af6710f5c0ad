from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import chat, merkle


def _messages(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, segment int, t int, held int")


def _text(t):
    return ("text", t, None, None, None, None, None)


def test_parts_become_placeholders(spark):
    rows = [
        (1, 0, "user", [_text("see "), ("image", None, "i.png", 57, 28, None, None), _text(" and [IMAGE] \\A"), ("audio", None, "a.wav", None, None, 1.01, None)], 0, 0, 0),
        (1, 1, "assistant", [("document", None, "d.pdf", None, None, None, 3), _text("<s>ok</s>")], 0, 0, 0),
        (1, 2, "tool", [("video", "x", None, None, None, None, None)], 0, 0, 0),
        (1, 3, None, None, 0, 0, 0),
        (1, None, "user", [], 0, 0, 0),
    ]
    made = chat.format_chats(_messages(spark, rows)).orderBy("segment").collect()
    assert made[0].formatted == "[INST][/INST]"
    text = made[1].formatted
    assert text.startswith("[INST]see [IMAGE] and \\") and text.count("[IMAGE]") == 1 and text.count("</s>") == 1
    assert [tuple(a) for a in made[1].attachments] == [("image", "i.png", 3), ("audio", "a.wav", 26), ("document", "d.pdf", 3072), ("video", None, 0)]
    (span,) = made[1].loss_spans
    assert text[span.start : span.start + span.length].startswith("[DOCUMENT]\\")
    turns = spark.createDataFrame([(text,)], "f string").select(chat.turns_of(F.col("f")).alias("t")).head().t
    assert [t.role for t in turns] == ["user", "assistant", "tool", ""]
    assert turns[1].text == "[DOCUMENT]<s>ok</s>"


def test_escapes_are_reversible(spark):
    signs = ["", "\\", "\\0", "\\A", "[INST]", "[/INST]", "[INST", "]", "<s></s>", "[ROLE]x[/ROLE]", "\\\\0[/TURN]", "[[SYS]]", "a[/TURN]\\"]
    texts = [a + b for a in signs for b in signs]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).collect()
    for r in rows:
        assert r.back == r.t and not any(c in r.e for c in chat.CONTROLS)


def test_every_turn_reads_back(spark):
    signs = ["x", "", "[/INST]", "<s>", "\\", "</s>[INST] ok", "[/", "<", "[TURN]"]
    roles = ["user", "assistant", "system", "tool", "", "[ROLE]", None]
    rows = [(c, t, roles[(c + t) % len(roles)], [_text(signs[(c * 5 + t * 3) % len(signs)])], 0, 0, 0) for c in range(9) for t in range(c * 20)]
    rows.append((50, 0, "user", [_text(None)], 0, 0, 0))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(_messages(spark, rows))).collect()}
    import hashlib

    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        said = "".join(f"{r[2] or ''}\n{r[3][0][1] or ''}\n" for r in own)
        loss = "".join(r[3][0][1] or "" for r in own if r[2] == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_chats(_messages(spark, []))).collect() == []


PAGES = "page_id long, url string, html string, file int, seq int, node int"


def test_audit_finds_each_kind_of_damage(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7), 0, 0, 0) for i in range(1200)] + [(None, None, None, 0, 0, 0)] * 2 + [(5, "http://h/5", "<p>5</p>" * 5, 0, 0, 0)]
    records = merkle.archive(spark.createDataFrame(rows, PAGES)).cache()
    whole = records.count()
    assert whole == len(rows)
    held = records.collect()
    for r in held:
        if r.seq:
            (before,) = [x for x in held if (x.file, x.seq) == (r.file, r.seq - 1)]
            assert r.start_offset == before.start_offset + before.length
    assert Counter(r.status for r in merkle.audit(records, records).collect()) == {"intact": whole}
    replica = records.where("page_id IS NULL OR page_id NOT IN (17, 900)").withColumn("record", F.when(F.col("page_id") == 30, "X").otherwise(F.col("record")))
    found = {r.page_id: r.status for r in merkle.audit(records, replica).collect() if r.status != "intact"}
    assert found == {17: "missing", 900: "missing", 30: "changed"}
    places, levels = merkle.shape(records, replica)
    trees = [merkle.tree(x, places, levels) for x in (replica, records)]
    assert sorted(r.kind for r in merkle.differing(*trees).collect()) == ["added", "added", "changed"]


def test_audit_of_empty_replicas(spark):
    none = merkle.archive(spark.createDataFrame([], PAGES))
    one = merkle.archive(spark.createDataFrame([(1, "u", "h", 0, 0, 0)], PAGES))
    assert merkle.audit(none, none).collect() == []
    assert [r.status for r in merkle.audit(one, none).collect()] == ["missing"]


def test_audit_reports_records_only_the_other_replica_holds(spark):
    none = merkle.archive(spark.createDataFrame([], PAGES))
    some = merkle.archive(spark.createDataFrame([(i, "u", "h", 0, 0, 0) for i in range(40)], PAGES)).cache()
    place = lambda rows: sorted((r.page_id, r.file, r.seq, r.start_offset, r.length) for r in rows)
    found = merkle.audit(none, some).collect()
    assert {r.status for r in found} == {"added"} and place(found) == place(some.collect())
    part = some.where("page_id NOT IN (3, 4)")
    assert Counter(r.status for r in merkle.audit(part, some).collect()) == {"intact": 38, "added": 2}
