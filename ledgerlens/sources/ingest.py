"""Raw explorer records to typed tables. All raw columns are strings; unreadable values get the stated defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import scalars as S

_TX = [
    "blockNumber", "timeStamp", "hash", "nonce", "blockHash", "transactionIndex", "from", "to", "value", "gas", "gasPrice", "isError", "txreceipt_status", "input", "contractAddress",
    "cumulativeGasUsed", "gasUsed", "confirmations", "methodId", "functionName", "traceId", "type", "logIndex",
]
RAW_TX = T.StructType([T.StructField(n, T.StringType()) for n in _TX])
RAW_TOKEN = T.StructType([T.StructField(n, T.StringType()) for n in ("blockNumber", "timeStamp", "hash", "from", "to", "contractAddress", "tokenName", "tokenSymbol", "value", "gas", "gasPrice", "gasUsed", "tokenDecimal")])
CACHE = T.MapType(T.StringType(), T.StructType([T.StructField("normal_txs", T.ArrayType(RAW_TX)), T.StructField("internal_txs", T.ArrayType(RAW_TX)), T.StructField("contract_address", T.StringType())]))

BLOCKS_PER_DAY, GENESIS = 6500, 1_438_214_400


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cohort cache, one JSON object ``{address: {normal_txs, internal_txs}}``: a row ``wallet, stream, ord, raw`` for each transaction."""
    return _cache_rows(spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CACHE)).alias("wallet", "w")))


def _cache_rows(whole: DataFrame) -> DataFrame:
    both = whole.select(F.lower("wallet").alias("wallet"), F.explode(F.array(F.struct(F.lit(0).alias("stream"), F.col("w.normal_txs").alias("t")), F.struct(F.lit(1).alias("stream"), F.col("w.internal_txs").alias("t")))).alias("s"))
    return both.select("wallet", F.col("s.stream").alias("stream"), F.posexplode("s.t").alias("ord", "raw"))


#: What addresses begin with in a JSON text; records of the splittable reader end there.
_MARK = '"0x'


def read_large_cache(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`read_cache` from files of any size, each read by as many tasks as it has splits.

    A cache is one JSON object, but its text is read as records that end before each address or hash. A record that
    begins with an address, a colon and a brace is a wallet's key (no key inside a wallet's entry is an address); the
    records up to the next such one are its entry, which is put together and parsed by itself. Where an entry begins in
    one split and goes on in the next, the split's last key is carried over. Nothing of the size of a file is in one place.
    """
    at = ["file", "block", "row"]
    lines = spark.read.option("lineSep", _MARK).text(path).select(
        F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value"),
    )
    begins = F.when(F.col("value").rlike(r"^[0-9a-fA-F]{40}\"\s*:\s*\{"), F.struct("block", "row"))
    upto = W.partitionBy("file", "block").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("begins", begins).withColumn("entry", F.last("begins", ignorenulls=True).over(upto))
    # what a split begins with belongs to the last key of the splits before it; a file has few splits
    ends = lines.groupBy("file", "block").agg(F.max(begins).alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.withColumn("carry", before).select("file", "block", "carry")
    rows = marked.join(carried, ["file", "block"]).select(*at, F.coalesce("entry", "carry").alias("entry"), "value").where("entry IS NOT NULL")
    parts = rows.groupBy("file", "entry").agg(F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("x"))
    text = F.regexp_replace(F.concat(F.lit("{" + _MARK), F.array_join(F.transform("x", lambda x: x.value), _MARK)), r"\s+$", "")
    # an entry that another follows ends with a comma in place of the brace; the last has the file's own closing brace
    whole = parts.select(text.alias("t")).select(F.when(F.col("t").endswith(","), F.concat(F.expr("left(t, length(t) - 1)"), F.lit("}"))).otherwise(F.col("t")).alias("text"))
    return _cache_rows(whole.select(F.explode(F.from_json("text", CACHE)).alias("wallet", "w")))


def cohort(cache: DataFrame, wallets: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A labelled cohort ``listed(wallet, label)`` with its cached rows, and who is left out: ``wallet, label, reason``.

    ``wallets`` are the cache's keys. Addresses that the cache doesn't have are ``missing``, those without any transaction
    ``empty``.
    """
    held = cache.select("wallet").distinct().withColumn("_rows", F.lit(True))
    known = wallets.select("wallet").distinct().withColumn("_key", F.lit(True))
    state = listed.join(known, "wallet", "left").join(held, "wallet", "left")
    reason = F.when(F.col("_key").isNull(), "missing").when(F.col("_rows").isNull(), "empty")
    skipped = state.withColumn("reason", reason).where("reason IS NOT NULL").select("wallet", "label", "reason")
    return cache.join(listed.select("wallet", "label"), "wallet"), skipped


def cached_wallets(spark: SparkSession, path: str) -> DataFrame:
    """``wallet``: the keys of a cache, by the same splittable reading."""
    found = spark.read.option("lineSep", _MARK).text(path).select(F.lower(F.regexp_extract("value", r"^([0-9a-fA-F]{40})\"\s*:\s*\{", 1)).alias("w")).where("w <> ''")
    return found.select(F.concat(F.lit("0x"), "w").alias("wallet")).distinct()


def read_response(spark: SparkSession, path: str, field: str, element: T.StructType) -> DataFrame:
    """Rows of ``field.result`` of an explorer response; an error message in its place gives no rows."""
    outer = T.StructType([T.StructField(field, T.StructType([T.StructField("status", T.StringType()), T.StructField("message", T.StringType()), T.StructField("result", T.StringType())]))])
    texts = spark.read.text(path, wholetext=True).select(F.from_json("value", outer).alias("r"))
    rows = F.coalesce(F.from_json(f"r.{field}.result", T.ArrayType(element)), F.array().cast(T.ArrayType(element)))
    return texts.select(F.posexplode(rows).alias("ord", "raw")).where("raw IS NOT NULL")


def to_tx(rows: DataFrame, wallet: Column | None = None) -> DataFrame:
    """Canonical transactions from ``stream, ord, raw`` (and ``wallet``); amounts beyond 38 digits count as 0."""
    raw = lambda n: F.coalesce(F.col(f"raw.{n}"), F.lit(""))
    return rows.select(
        (F.col("wallet") if wallet is None else wallet).alias("wallet"), "stream", F.col("ord").cast("long").alias("ord"), S.safe_int(raw("timeStamp")).alias("ts"),
        F.lower(raw("from")).alias("src"), F.lower(raw("to")).alias("dst"), F.coalesce(raw("value").try_cast("decimal(38,0)"), F.lit(0)).cast("decimal(38,0)").alias("value"),
        S.safe_int(raw("gasPrice")).alias("gas_price"), S.safe_int(raw("gasUsed")).alias("gas_used"), S.safe_int(raw("nonce")).alias("nonce"), (raw("isError") == "1").alias("is_error"),
        F.coalesce(F.col("raw.input"), F.lit("")).alias("input"), F.lower(raw("contractAddress")).alias("contract"), F.lower(raw("hash")).alias("tx_hash"),
    )


def to_tokens(rows: DataFrame) -> DataFrame:
    """Token transfers with ``amount`` (exact, null beyond 38 digits) and ``units`` (by decimals; 0 where undefined)."""
    raw = lambda n: F.coalesce(F.col(f"raw.{n}"), F.lit(""))
    units = F.try_divide(raw("value").try_cast("double"), F.pow(F.lit(10.0), S.safe_int(raw("tokenDecimal"), 18)))
    return rows.select("wallet", F.col("ord").cast("long").alias("ord"), S.safe_int(raw("timeStamp")).alias("ts"), F.lower(raw("from")).alias("src"), F.lower(raw("to")).alias("dst"), raw("value").try_cast("decimal(38,0)").alias("amount"), F.coalesce(units, F.lit(0.0)).alias("units"), F.lower(raw("contractAddress")).alias("contract"), raw("tokenSymbol").alias("symbol"))


_ENTITY = T.MapType(T.StringType(), T.StructType([T.StructField(n, T.StringType()) for n in ("label", "type", "risk_note")]))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Known entities from ``{category: {address: {label, type}}}``: lower-cased, the last category wins, comments are left out.

    Categories rank by their place in the file, which a map type keeps; both spellings of types are brought to one.
    """
    cats = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("rank", "category", "body")).where("category NOT LIKE '\\\\_%'")
    rows = cats.select("rank", "category", F.posexplode(F.from_json("body", _ENTITY)).alias("pos", "address", "e")).where("address NOT LIKE '\\\\_%'")
    last = F.row_number().over(W.partitionBy("address").orderBy(F.desc("rank"), F.desc("pos")))
    flat = rows.select(F.lower("address").alias("address"), "rank", "pos", "category", F.col("e.label").alias("label"), canonical_type(F.col("e.type")).alias("type"))
    return flat.withColumn("_n", last).where("_n = 1").select("address", "label", "type", "category")


def canonical_type(c: Column) -> Column:
    """One spelling for entity types."""
    return F.when(c.isin("known_cex", "CEX"), "CEX").when(c.isin("known_dex", "DEX", "DEX_ROUTER"), "DEX").when(c.isin("mixer_suspected", "MIXER"), "MIXER").when(c.isin("bridge", "BRIDGE"), "BRIDGE").otherwise(c)


def read_addresses(spark: SparkSession, path: str, label: str) -> DataFrame:
    """A labelled address list: one a line, ``#`` comments; lower-cased, in order, the first of repeats."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.lower(F.trim("value")).alias("wallet")).where("wallet LIKE '0x%' AND length(wallet) = 42")
    return lines.groupBy("wallet").agg(F.min("ord").alias("ord")).withColumn("label", F.lit(label))


def start_block(days: int, now: int) -> int:
    """First block of a look-back window."""
    return max(0, (now - days * 86400 - GENESIS) // 86400 * BLOCKS_PER_DAY)


def first_seen(tx: DataFrame) -> DataFrame:
    """Wallet ages: first time that an address shows up at either end."""
    return tx.select(F.explode(F.array("src", "dst")).alias("address"), "ts").where("address <> ''").groupBy("address").agg(F.min("ts").alias("first_ts"))


def merge_internal(creator: DataFrame, contract: DataFrame) -> DataFrame:
    """Internal transfers of a creator and its contract, each (wallet, hash, trace) once; the creator's row wins."""
    from ..operators.casestore import dedup_internal

    return dedup_internal(creator.withColumn("fetch", F.lit(0)).unionByName(contract.withColumn("fetch", F.lit(1))))


def split_contracts(addresses: DataFrame, code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Externally owned accounts and contracts, by bytecode ``code(address, bytecode)``, which may hold rows of several chains: code on any counts."""
    deployed = code.where("length(bytecode) > 2").select("address").distinct()
    return addresses.join(deployed, "address", "left_anti"), addresses.join(deployed, "address", "left_semi")


def contract_info(addresses: DataFrame, code: DataFrame) -> DataFrame:
    """``address, is_contract, chains, source_verified`` by ``code(address, chain, bytecode, abi)``; ``chains`` are those with code, in order.

    A source is verified where some chain has an interface for it; an explorer's message in its place is none.
    """
    deployed = F.length("bytecode") > 2
    known = code.groupBy("address").agg(F.sort_array(F.collect_set(F.when(deployed, F.col("chain")))).alias("chains"), F.bool_or(F.coalesce(deployed & F.ltrim("abi").startswith("["), F.lit(False))).alias("source_verified"))
    none = F.expr("cast(array() AS array<string>)")
    out = addresses.join(known, "address", "left")
    return out.select("address", (F.size(F.coalesce("chains", none)) > 0).alias("is_contract"), F.coalesce("chains", none).alias("chains"), F.coalesce("source_verified", F.lit(False)).alias("source_verified"))


def write_matrix(features: DataFrame, path: str) -> None:
    """The feature matrix as CSV with a header: doubles to six places, undefined values empty."""
    from ..operators.cohort import matrix

    matrix(features).write.option("header", True).option("emptyValue", "").csv(path)
