"""Token streams cut anywhere, with parts out of order and dealt over runs, against reading them whole."""

import json
import random

from datamill.streaming import incremental, tokens


def plain(text):
    """What a reader of the whole stream hears."""
    out = []
    for line in text.split("\n")[:-1]:
        if line.strip() == "data: [DONE]":
            break
        if line.strip().startswith("data: "):
            try:
                out.append(json.loads(line.strip()[6:])["choices"][0]["delta"]["content"] or "")
            except (ValueError, LookupError, TypeError):
                pass
    return "".join(out)


def event(content):
    return "data: " + json.dumps({"choices": [{"delta": {"content": content}}]}) + "\n"


STREAMS = {
    1: event("one ") + ": ping\n\n" + event("twö \n☃") + "data: [DONE]\n" + event("late"),
    2: event("never") + 'data: {"choices":[{"delta":{"content":"ended"}}]}',
    3: "data: {broken\ndata: [1]\ndata: {}\n" + 'data: {"choices":[]}\ndata: {"choices":[{"delta":null}]}\n' + event("") + event("x"),
    4: "",
    5: "\n\n  " + event("padded") + "  data: [DONE]  \n",
    6: event("w" * 3000) + event("y"),
}


def test_lines():
    assert tokens.content_of(event("a").strip()) == "a" and tokens.content_of(": ping") is None and tokens.content_of("data: 7") is None
    assert tokens.is_end("  data: [DONE] ") and not tokens.is_end("data: [DONE")


def test_parts_over_several_runs(spark, tmp_path):
    r = random.Random(9)
    rows = []
    for stream, text in STREAMS.items():
        at = n = 0
        while at < len(text):
            k = r.randint(0, 12)
            rows.append((stream, n, text[at : at + k]))
            at, n = at + k, n + 1
    batches = [[], [], [], []]
    for row in rows:
        batches[r.randrange(4)].append(row)
    batches[3] += r.sample(rows, 20)  # sent twice
    schema = "stream int, at long, part string"
    for batch in batches:
        r.shuffle(batch)
        spark.createDataFrame(batch, schema).write.mode("append").parquet(f"{tmp_path}/in")
        with tokens.keyed_state(spark):
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            incremental.process_new(stream, lambda df: tokens.token_lines(df, "stream"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.conf.get(tokens.PROVIDER) != tokens.STORE
    got = {}
    for stream, at, content in sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())):
        assert at == len(got.setdefault(stream, []))
        got[stream].append(content)
    assert {s: "".join(got.get(s, [])) for s in STREAMS} == {s: plain(t) for s, t in STREAMS.items()}


def test_parts_in_order_need_no_look_into_the_store():
    """The state of a stream is read and written once a batch; the map of early parts only where parts wait."""
    import pandas as pd

    class Place:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Early(dict):
        calls = 0

        def counted(self):
            self.calls += 1

        def iterator(self):
            self.counted()
            return iter([((k,), (v,)) for k, v in self.items()])

        def updateValue(self, key, value):
            self.counted()
            self[key[0]] = value[0]

        def clear(self):
            self.counted()
            super().clear()

        def removeKey(self, key):
            self.counted()
            del self[key[0]]

    class Handle:
        def getValueState(self, *_):
            return Place()

        def getMapState(self, *_):
            return Early()

    reader = tokens.TokenLines(["stream"])
    reader.init(Handle())
    text = event("a") + event("b") + event("c")
    rows = [(i, text[7 * i : 7 * i + 7]) for i in range(-(-len(text) // 7))]
    say = lambda some: [c for f in reader.handleInputRows((1,), iter([pd.DataFrame(some, columns=["at", "part"])]), None) for c in f["content"]]
    half = len(rows) // 2
    said = say(rows[:half])
    assert reader.early.calls == 0
    said += say(rows[half + 1 :])
    assert len(reader.early) == len(rows) - half - 1
    said += say(rows[half : half + 1])
    assert said == ["a", "b", "c"] and reader.place.value[4] == 0
