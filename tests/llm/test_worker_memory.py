"""What a worker holds: workers serve one stage after another, and an executor's memory is that of all it holds."""

import tracemalloc

import numpy as np
import pyarrow as pa

from gneiss.llm import language, nearcopies, queries, tokens
from gneiss.llm.common import worker_state

TEXT = "Der schnelle braune Fuchs springt über den faulen Hund und läuft in den Wald. "


def test_other_stages_drop_what_tokenizing_remembers(spark, monkeypatch):
    docs = spark.createDataFrame([(1, TEXT, "de")], "doc_id long, text string, lang string")
    path, found = queries.tokenizer_file("word_bpe_49k.json"), []
    whole = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a, **b: (found.append(run), whole(self, run, *a, **b))[1])
    language.identify(docs, language.learn(docs))
    nearcopies.fingerprints(docs)
    assert len(found) == 3
    for run in found:
        list(tokens.word_ids_of([TEXT], path))
        assert worker_state()["encoded"]
        list(run(iter([])))
        assert not worker_state().get("encoded")


def test_language_takes_little_memory_for_many_short_texts():
    batch = pa.RecordBatch.from_arrays([pa.array([TEXT * 20] * 1000)], names=["text"])
    language.folding()
    tracemalloc.start()
    counts = [n.sum() for _, n in language.counted_texts(batch, "text")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(counts) == 1000 and len(set(counts)) == 1
    assert peak < 80e6


def test_fewer_remembered_words_give_the_same_ids():
    path = queries.tokenizer_file("word_bpe_49k.json")
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)}" for i in range(500)) for k in range(12)]
    worker_state().pop("encoded", None)
    want = list(tokens.word_ids_of(texts, path))
    worker_state().pop("encoded", None)
    found = [ids for t in texts for ids in tokens.word_ids_of([t], path, 600)]
    assert found == want and all(np.frombuffer(x, "<u4").size for x in found)
    known = tokens.encodings("ids", path, 600)
    assert len(known.new) <= 600 and len(known.old) <= 600
