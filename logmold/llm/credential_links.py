"""Secret scan with multipart credential linking.

Strong patterns (``BASE``) are always reported. Weak ones, a name of an
account, an opaque token, a service address, mean nothing alone: they are
reported when a complementary part stands within the same scope, ``SCOPE``
characters. One pass over the texts finds all parts; an interval join over the
parts (cells of ``SCOPE`` characters of one text, so that a long text with many
parts is spread out) then tells which weak ones are confirmed.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmold.llm.common import map_batches, prepare, stash, texts

SCOPE = 300
#: Kinds in the order that decides between equal starts; the first three are strong.
KINDS = ["assign", "access", "hex", "account", "opaque", "endpoint"]
BASE = 3
#: What a part is to others: an identifier, a secret or an endpoint.
ROLE = {"assign": "s", "access": "i", "hex": "s", "account": "i", "opaque": "s", "endpoint": "e"}

# The patterns that callers rely on.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api")

# Weak parts.
ACCOUNT = re.compile(r"""(?<![a-z0-9])(access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
ACCOUNT_HINTS = ("_id", "keyid", "clientid", "accountid", "user", "login")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]+|s3|ftp|amqps?|mongodb|postgres(?:ql)?|mysql|redis)://[^\s"'<>]+""", re.A)


def _varied(token: str) -> bool:
    """Digits and both cases, and at least 12 different characters."""
    return (len(set(token)) >= 12 and any(map(str.isdigit, token)) and any(map(str.islower, token))
            and any(map(str.isupper, token)))


def parts(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of each part, strong and weak, in code points."""
    if not text:
        return []
    out, low = [], text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(h in low for h in ACCOUNT_HINTS):
        out += [(m.start(), 3, m.end()) for m in ACCOUNT.finditer(text)]
    strong = [(a, b) for a, k, b in out if k < BASE]
    out += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text)
            if _varied(m[0]) and not any(a < m.end() and m.start() < b for a, b in strong)]
    if "://" in text:
        out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return sorted(out)


def _find():
    def work(batch: pa.RecordBatch) -> dict:
        found = [parts(t) for t in batch["text"].to_pylist()]
        return {c: batch[c] for c in ("k1", "k2", "doc_id")} | {
            "parts": [[{"start": a, "kind": k, "end": b} for a, k, b in f] for f in found]}

    return work


def _kind(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), number + 1)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _kind(x["kind"]), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, base`` and
    ``linked`` (arrays of start, kind, end) for each row of ``docs (doc_id, text)``.

    An account is reported near a secret, an opaque token near an identifier,
    an endpoint near both an identifier and a secret; an identifier or secret
    counts whether it is strong or weak, but a part never confirms itself. Null
    and empty texts have no spans. Repeated rows get the same spans; an empty
    table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = stash(map_batches(texts(docs), _find, "k1 long, k2 long, doc_id long, parts array<struct<start int, kind int, end int>>"), "parts")
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("part.kind") + 1)
    # texts with a weak part and at least one more
    each = rows.where(F.exists("parts", lambda x: x["kind"] >= BASE) & (F.size("parts") > 1)).select(
        "k1", "k2", F.explode("parts").alias("part")).distinct().select("k1", "k2", "part", role.alias("role"))
    # all cells from a part's start to its end, on one side one more at either end
    cells = lambda more: F.explode(F.sequence(F.floor(F.col("part.start") / SCOPE) - more, F.floor(F.col("part.end") / SCOPE) + more))
    weak = each.where(F.col("part.kind") >= BASE).withColumn("cell", cells(1))
    other = each.where(F.col("role") != "e").select("k1", "k2", cells(0).alias("cell"), F.col("part").alias("near"), F.col("role").alias("near_role"))
    gap = F.greatest(F.col("near.start") - F.col("part.end"), F.col("part.start") - F.col("near.end"))
    met = weak.join(other, ["k1", "k2", "cell"]).where((gap <= SCOPE) & (F.col("role") != F.col("near_role"))).groupBy("k1", "k2", "part", "role").agg(
        F.max((F.col("near_role") == "i").cast("int")).alias("i"), F.max((F.col("near_role") == "s").cast("int")).alias("s"))
    linked = met.where("(role = 'i' and s = 1) or (role = 's' and i = 1) or (role = 'e' and i = 1 and s = 1)") \
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_set("part")).alias("linked"))
    none = F.array().cast("array<struct<start int, kind int, end int>>")
    many = rows.join(linked, ["k1", "k2"], "left").select(
        "doc_id", F.filter("parts", lambda x: x["kind"] < BASE).alias("base"), F.coalesce("linked", none).alias("linked"))
    count = lambda n: F.size(F.filter("base", lambda x: x["kind"] == n)).cast("long")
    return many.select("doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(BASE)],
                       F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       _joined(F.sort_array(F.concat("base", "linked"))).alias("spans"), "base", "linked")
