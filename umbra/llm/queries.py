"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, digest, langid, licenses, lm, mixing, pii, simhash, tokenbin

END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(n: int, k: int) -> Column:
    """Whether the document lies in the fold; a null doc_id lies in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == k, F.lit(False))


def op1_kneser_ney(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = fold(7, 2)
    info = lm.train(docs.where(~held))
    return lm.score(docs, info, {"doc_id": F.col("doc_id"), "held_out": held})


def op2_pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op4_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], rows.schema)
    messages = chat.written(chat.linear(rows.unionByName(extra), "conv_id", "turn"), "messages")
    members = chat.chosen_paths(messages.select("tree", "node", "parent", "score"))
    back = chat.read_back(chat.format_paths(messages, members))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.when(F.col("tree") != "null", F.col("tree")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_mixing(spark, sf_dir):
    p = mixing.plan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return p.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = fold(5, 0)
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": held})


def op8_decontaminate(spark, sf_dir):
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark, sf_dir):
    return tokenbin.token_output(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op10_digests(spark, sf_dir):
    return digest.with_next(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_kneser_ney, op2_pii, op3_simhash, op4_licenses, op5_chat, op6_mixing, op7_langid, op8_decontaminate, op9_token_files, op10_digests)}


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\e')"
    for control, code in chat.CONTROL.items():
        out = f"replace({out}, '{control}', '{code}')"
    return out


OP5_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.TURN + chat.BODY + chat.STOP)} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""


#: Every aligned pair of words, without a hash: the most within 13 places, against 0.8 of 13 or of the item's words.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{decontam.SEPARATOR}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{decontam.SEPARATOR}'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM b),
same AS (SELECT doc_id, item_id, n, i - j AS shift, j FROM dw JOIN bw USING (word)),
near AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS m FROM same)
SELECT doc_id, item_id, max(m / n) AS overlap, CAST(max(m) AS INTEGER) AS matched FROM near WHERE m >= 0.8 * n GROUP BY doc_id, item_id"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat": OP5_SQL, "op8_decontaminate": OP8_SQL}
