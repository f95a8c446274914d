import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from feedline.llm.batches import text_bytes
from feedline.llm.chat import assemble, digests, format_conversations, parse
from feedline.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, part string, formatted string"


def brute(rows):
    by = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(rows, key=key):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                     len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r)[1:5] for r in digests(format_conversations(df)).collect()}


def test_control_strings_nulls_ties_and_repeats(spark):
    rng = random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "é", "x", " ", "<", "[", "/s>", "\\\\", "🎈", "INST]"]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2, 3]),
             rng.choice([None, "", "user", "assistant", "as\nsist", "<s>", "\\", "[INST] "]),
             rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))])) for _ in range(400)]
    rows += [(5, 0, "user", "y" * 300_000), (5, 1, "assistant", "</s>" * 50_000)] + [(6, i, "assistant", "hm") for i in range(3000)]
    df = spark.createDataFrame([(*r, "p", "f") for r in rows], SCHEMA).repartition(4)
    assert got(df) == brute(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == {}


def test_segments_do_not_depend_on_their_neighbours():
    texts = ["<s", ">", "a<", "/s>", "[IN", "ST]", "\\", "</s>"]
    buf, offs = text_bytes(pa.array(texts))
    out, seg, t0, t1 = assemble(["user"] * len(texts), buf, offs)
    for i, t in enumerate(texts):
        b, o = text_bytes(pa.array([t]))
        alone, *_ = assemble(["user"], b, o)
        assert out[seg[i]:seg[i + 1]].tobytes() == alone.tobytes()
    assert parse(out.tobytes().decode()) == [("user", t) for t in texts]


def test_parse_refuses_what_is_no_turn():
    with pytest.raises(ValueError):
        parse("[INST] user\nx")


def test_query_reads_back_all_conversations(spark):
    base = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", odd), (-1, 1, "assistant", odd)]
    d = {r[0]: tuple(r)[1:5] for r in QUERIES["op6_chat_formatting"](spark, base).collect()}
    assert d == brute(rows)


def test_loss_mask_covers_texts_of_the_assistant_only(spark):
    df = spark.createDataFrame([(1, 0, "user", "é<s>"), (1, 1, "assistant", "ü</s>"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    rows = format_conversations(df, 1).collect()
    assert [r.formatted[x.start:x.end] for r in rows for x in r.loss] == ["ü\\</s>", ""]
    assert np.array_equal([r.n_turns for r in rows], [3])
