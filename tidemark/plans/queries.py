"""The registered queries and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.prefix import running
from ..operators import cache, commands, compaction, files, visibility
from ..operators.filters import BloomFilter
from ..operators.visibility import KEY
from ..sources import wal
from ..sources.adapters import edit_log, events_log, table

#: The change log and what hangs on it, for the SQL side.
L = """
L AS (SELECT CAST(user_id % 2 AS INT) AS cf, printf('%012d', user_id) AS user_key, event_id + 1 AS seq,
             CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
             event_id // 8 AS batch_id, event_id % 8 AS ordinal, event_id // 1000 + 1 AS file_no FROM events)"""
NEW = L + """, N AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cf, user_key ORDER BY seq DESC) AS r FROM L) WHERE r = 1),
V AS (SELECT cf, user_key, seq, value FROM N WHERE op = 0)"""
FILES = L + """, F AS (SELECT cf, file_no, count(*) AS num_entries, CAST(sum(op) AS BIGINT) AS num_deletes, min(user_key) AS smallest_key, max(user_key) AS largest_key,
             min(seq) AS min_seq, max(seq) AS max_seq FROM L GROUP BY cf, file_no)"""
EDITS = FILES + """, G AS (SELECT cf, (file_no - 1) // 4 AS g, count(*) AS n, min(smallest_key) AS smallest_key, max(largest_key) AS largest_key,
             CAST(sum(num_entries * 20) AS BIGINT) AS file_size, max(max_seq) AS last_sequence FROM F GROUP BY 1, 2 HAVING count(*) = 4),
E AS (SELECT file_no * 4 AS edit_id, cf, 'add_file' AS kind, 0 AS level, file_no AS file_number, smallest_key, largest_key, num_entries * 20 AS file_size,
             NULL AS cf_name, file_no + 1 AS next_file_number, max_seq AS last_sequence FROM F
      UNION ALL SELECT G.g * 16 + 18, F.cf, 'delete_file', 0, F.file_no, NULL, NULL, NULL, NULL, NULL, NULL FROM F JOIN G ON F.cf = G.cf AND (F.file_no - 1) // 4 = G.g
      UNION ALL SELECT g * 16 + 18, cf, 'add_file', 1, 100000 + g, smallest_key, largest_key, file_size, NULL, 100001 + g, last_sequence FROM G
      UNION ALL SELECT * FROM (VALUES (1, 0, 'add_cf', NULL, NULL, NULL, NULL, NULL, 'cf_user', NULL, NULL), (2, 1, 'add_cf', NULL, NULL, NULL, NULL, NULL, 'cf_system', NULL, NULL),
             (3, 2, 'add_cf', NULL, NULL, NULL, NULL, NULL, 'scratch', NULL, NULL), (9, 2, 'drop_cf', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)))"""
SNAPSHOT, LATE = 5000, (2500, 6000)
LOW, HIGH = "000000000020", "000000000060"
POINT = "000000000007"

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, prefix: str = L):
    """Register a function of (log, spark, sf_dir) under its name, with the SELECT that states its result."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(events_log(spark, sf_dir), spark, sf_dir)
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {prefix.strip()}\n{sql}" if prefix else sql
        return f

    return add


# reads ------------------------------------------------------------------------------------------------------------------


@query("SELECT cf, user_key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, user_key ORDER BY seq DESC) AS r FROM L WHERE seq <= 5000) WHERE r = 1 AND op = 0")
def snapshot_scan(log: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.live(log, SNAPSHOT).orderBy(*KEY)


@query("SELECT cf, user_key, seq, value FROM V", NEW)
def full_scan(log, spark, sf_dir):
    return visibility.live(log).orderBy(*KEY)


@query(f"SELECT cf, user_key, seq, value FROM V WHERE user_key = '{POINT}' AND cf = 1", NEW)
def point_get(log, spark, sf_dir):
    return visibility.live(log.where((F.col("cf") == 1) & (F.col("user_key") == POINT)))


@query("SELECT cf, user_key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, user_key ORDER BY seq DESC) AS r FROM L WHERE seq <= 3000 AND user_key < '000000000020') WHERE r = 1 AND op = 0")
def get_at_snapshot(log, spark, sf_dir):
    return visibility.live(log.where(F.col("user_key") < LOW), 3000)


@query(
    """, R AS (SELECT event_id AS request_id, CAST(user_id % 2 AS INT) AS cf, printf('%012d', user_id) AS user_key, event_id // 2 + 1 AS at_seq FROM events)
SELECT request_id, R.cf, R.user_key, at_seq, CASE WHEN op = 0 THEN seq END AS found_seq, CASE WHEN op = 0 THEN value END AS value
FROM R ASOF LEFT JOIN L ON R.cf = L.cf AND R.user_key = L.user_key AND R.at_seq >= L.seq"""
)
def multi_get_asof(log, spark, sf_dir):
    e = table(spark, sf_dir, "events")
    requests = e.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 2).cast("int").alias("cf"), F.format_string("%012d", "user_id").alias("user_key"), F.expr("event_id div 2 + 1").alias("at_seq"))
    return visibility.asof(requests, log)


@query(f"SELECT cf, user_key, seq, value FROM V WHERE user_key >= '{LOW}' AND user_key < '{HIGH}'", NEW)
def range_scan(log, spark, sf_dir):
    return visibility.live(log.where((F.col("user_key") >= LOW) & (F.col("user_key") < HIGH))).orderBy(*KEY)


@query(f"SELECT cf, user_key, seq, value FROM V WHERE user_key >= '{HIGH}'", NEW)
def seek_scan(log, spark, sf_dir):
    return visibility.live(log.where(F.col("user_key") >= HIGH)).orderBy(*KEY)


@query(f"SELECT cf, min(user_key) AS user_key, arg_min(seq, user_key) AS seq, arg_min(value, user_key) AS value FROM V WHERE user_key >= '{HIGH}' GROUP BY cf", NEW)
def lower_bound(log, spark, sf_dir):
    """The first live key at or above a bound in each family, with its value."""
    first = F.min(F.struct("user_key", "seq", "value")).alias("v")
    return visibility.live(log.where(F.col("user_key") >= HIGH)).groupBy("cf").agg(first).select("cf", "v.user_key", "v.seq", "v.value")


@query("SELECT cf, user_key, seq, value FROM V", NEW)
def reverse_scan(log, spark, sf_dir):
    return visibility.live(log).orderBy(F.desc("cf"), F.desc("user_key"))


@query("SELECT cf, user_key, seq, value FROM V ORDER BY cf, user_key LIMIT 10", NEW)
def scan_limit(log, spark, sf_dir):
    return visibility.live(log).orderBy(*KEY).limit(10)


@query("SELECT cf, min(user_key) AS user_key FROM V GROUP BY cf", NEW)
def first_key(log, spark, sf_dir):
    return visibility.live(log).groupBy("cf").agg(F.min("user_key").alias("user_key"))


@query("SELECT cf, max(user_key) AS user_key FROM V GROUP BY cf", NEW)
def last_key(log, spark, sf_dir):
    return visibility.live(log).groupBy("cf").agg(F.max("user_key").alias("user_key"))


@query(f"SELECT cf, max(user_key) AS user_key FROM V WHERE user_key < '{HIGH}' GROUP BY cf", NEW)
def prev_key(log, spark, sf_dir):
    return visibility.live(log.where(F.col("user_key") < HIGH)).groupBy("cf").agg(F.max("user_key").alias("user_key"))


@query("SELECT cf, user_key, seq, op, value, row_number() OVER (PARTITION BY cf, user_key ORDER BY seq DESC, op DESC) AS version_rank FROM L")
def all_versions(log, spark, sf_dir):
    return visibility.versions(log.select(*KEY, "seq", "op", "value")).withColumn("version_rank", F.col("version_rank").cast("long"))


@query("SELECT cf, user_key, seq, op, seq % 4 AS run, row_number() OVER (PARTITION BY cf, user_key ORDER BY seq DESC, op DESC) AS version_rank FROM L")
def merged_versions(log, spark, sf_dir):
    """Four runs, merged into version order."""
    runs = [log.where(F.col("seq") % 4 == i).select(*KEY, "seq", "op", F.lit(i).cast("long").alias("run")) for i in range(4)]
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r)
    return visibility.versions(merged).withColumn("version_rank", F.col("version_rank").cast("long"))


@query("SELECT cf, user_key, seq, value FROM L WHERE cf = 9")
def scan_unknown_cf(log, spark, sf_dir):
    return visibility.live(log.where("cf = 9"))


@query("SELECT CAST(user_id % 3 AS INT) AS cf, count(*) AS rejected FROM events WHERE user_id % 3 = 2 GROUP BY 1", "")
def unknown_cf_writes(log, spark, sf_dir):
    writes = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("cf"))
    known = spark.createDataFrame([(0,), (1,)], "cf int")
    return writes.join(F.broadcast(known), "cf", "left_anti").groupBy("cf").agg(F.count("*").alias("rejected"))


# batches and sequence numbers ---------------------------------------------------------------------------------------


@query("SELECT batch_id, count(*) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_seq FROM L GROUP BY batch_id")
def sequence_allocation(log, spark, sf_dir):
    sizes = log.groupBy("batch_id").agg(F.count("*").alias("n"))
    return running(sizes, [], "batch_id", "n", "total").select("batch_id", "n", (F.col("total") - F.col("n") + 1).alias("first_seq"))


@query(", B AS (SELECT batch_id, coalesce(sum(count(*)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM L GROUP BY batch_id) SELECT batch_id, ordinal, cf, user_key, op, CAST(before + 1 + ordinal AS BIGINT) AS assigned_seq FROM L JOIN B USING (batch_id)")
def write_batch_apply(log, spark, sf_dir):
    first = sequence_allocation(log, spark, sf_dir).select("batch_id", "first_seq")
    return log.join(first, "batch_id").select("batch_id", "ordinal", *KEY, "op", (F.col("first_seq") + F.col("ordinal")).alias("assigned_seq"))


@query("SELECT batch_id, count(*) AS n, CAST(sum(1 - op) AS BIGINT) AS n_puts, CAST(sum(op) AS BIGINT) AS n_deletes, string_agg(DISTINCT CAST(cf AS VARCHAR), ',' ORDER BY CAST(cf AS VARCHAR)) AS involved_cfs FROM L GROUP BY batch_id")
def batch_summary(log, spark, sf_dir):
    return log.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.sum(1 - F.col("op")).cast("long").alias("n_puts"), F.sum("op").cast("long").alias("n_deletes"),
        F.array_join(F.array_sort(F.collect_set(F.col("cf").cast("string"))), ",").alias("involved_cfs"),
    )


def _le(x: str, width: int) -> str:
    """SQL: a little-endian integer in hex."""
    return f"printf('{'%02x' * width}', {', '.join(f'({x} // {256**i}) % 256' for i in range(width))})"


ENCODED = f""", T AS (SELECT *, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS v FROM L),
N1 AS (SELECT *, CASE WHEN op = 0 THEN '01' ELSE '02' END || {_le("cf", 4)} || {_le("length(user_key)", 4)} || lower(hex(user_key)) || CASE WHEN op = 0 THEN {_le("length(v)", 4)} || lower(hex(v)) ELSE '' END AS e FROM T),
R AS (SELECT batch_id, '01' || {_le("min(seq)", 8)} || {_le("count(*)", 4)} || string_agg(e, '' ORDER BY ordinal) AS record_hex FROM N1 GROUP BY batch_id)"""


def _records(log: DataFrame) -> DataFrame:
    """batch_id and the bytes of each batch (record); values are cents, as text."""
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    entry = codec.encode_entry(F.col("cf"), F.col("op"), F.col("user_key"), cents).alias("e")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", entry))), lambda x: x["e"])
    return log.groupBy("batch_id").agg(F.min("seq").alias("base"), ordered.alias("entries")).select("batch_id", codec.encode_batch(F.col("base"), F.col("entries")).alias("record"))


@query("SELECT batch_id, record_hex, CAST(length(record_hex) // 2 AS BIGINT) AS n_bytes FROM R", L + ENCODED)
def batch_encode(log, spark, sf_dir):
    """The bytes of each write batch."""
    return _records(log).select("batch_id", F.lower(F.hex("record")).alias("record_hex"), F.octet_length("record").cast("long").alias("n_bytes"))


@query("SELECT batch_id, ordinal, cf, user_key, op, v AS value FROM T", L + ENCODED)
def batch_decode(log, spark, sf_dir):
    """Encode each batch as bytes, and decode the bytes."""
    return _records(log).select("batch_id", F.posexplode(codec.decoded_entries(F.col("record"))).alias("i", "e")).select("batch_id", F.col("i").cast("long").alias("ordinal"), "e.cf", F.col("e.user_key").cast("string").alias("user_key"), "e.op", F.col("e.value").cast("string").alias("value"))


@query("SELECT batch_id, CAST(13 + sum(CASE WHEN op = 0 THEN 13 + length(user_key) + 8 ELSE 9 + length(user_key) END) AS BIGINT) AS encoded_bytes FROM L GROUP BY batch_id")
def batch_encoded_size(log, spark, sf_dir):
    size = F.octet_length("user_key") + F.when(F.col("op") == 0, 13 + 8).otherwise(9)
    return log.groupBy("batch_id").agg((F.sum(size) + 13).cast("long").alias("encoded_bytes"))


SEG = ", S AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY cf ORDER BY seq) AS BIGINT) AS used FROM (SELECT *, CAST(length(user_key) + 57 + CASE WHEN op = 0 THEN 8 ELSE 0 END AS BIGINT) AS bytes FROM L)), Z AS (SELECT *, (used - bytes) // 65536 AS segment FROM S) "


@query("SELECT cf, seq, bytes, used FROM S", L + SEG)
def memtable_usage(log, spark, sf_dir):
    return files.segments(log, 65_536).select("cf", "seq", "bytes", "used")


@query("SELECT cf, segment, count(*) AS num_entries, min(seq) AS min_seq, max(seq) AS max_seq, CAST(sum(bytes) AS BIGINT) AS bytes FROM Z GROUP BY cf, segment", L + SEG)
def memtable_rotation(log, spark, sf_dir):
    return files.segments(log, 65_536).groupBy("cf", "segment").agg(F.count("*").alias("num_entries"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.sum("bytes").alias("bytes"))


@query("SELECT cf, count(*) AS pending, min(segment) AS oldest FROM (SELECT DISTINCT cf, segment, max(segment) OVER (PARTITION BY cf) AS active FROM Z) WHERE segment < active AND segment >= 2 GROUP BY cf", L + SEG)
def pending_segments(log, spark, sf_dir):
    """Frozen segments that are not flushed, if the first two are."""
    s = files.segments(log, 65_536).select("cf", "segment").distinct()
    active = s.groupBy("cf").agg(F.max("segment").alias("active"))
    return s.join(active, "cf").where("segment < active and segment >= 2").groupBy("cf").agg(F.count("*").alias("pending"), F.min("segment").alias("oldest"))


# files and levels ---------------------------------------------------------------------------------------------------


@query("SELECT cf, file_no, num_entries, num_deletes, smallest_key, largest_key, min_seq, max_seq FROM F", FILES)
def flush_l0(log, spark, sf_dir):
    return files.file_stats(log, ["cf", "file_no"])


@query("SELECT cf, file_no, max_seq FROM F WHERE max_seq <= 5000", FILES)
def fully_visible_files(log, spark, sf_dir):
    return files.file_stats(log, ["cf", "file_no"]).where(F.col("max_seq") <= SNAPSHOT).select("cf", "file_no", "max_seq")


PROBES = ", P AS (SELECT DISTINCT cf, user_key FROM L)"


def _probes(log: DataFrame) -> DataFrame:
    return log.select(*KEY).distinct()


@query("SELECT P.cf, P.user_key, file_no FROM P JOIN F ON P.cf = F.cf AND P.user_key BETWEEN smallest_key AND largest_key", FILES + PROBES)
def candidate_files(log, spark, sf_dir):
    return files.candidates(_probes(log), flush_l0(log, spark, sf_dir).select("cf", "file_no", "smallest_key", "largest_key")).select(*KEY, "file_no")


@query("SELECT cf, user_key, file_no, seq, op = 1 AS deleted, value FROM N", NEW)
def level_lookup(log, spark, sf_dir):
    """Level 0, newest file first: prune by key range, then the newest version among the candidates; a tombstone says that the key is gone."""
    hit = files.candidates(_probes(log), flush_l0(log, spark, sf_dir).select("cf", "file_no", "smallest_key", "largest_key")).select(*KEY, "file_no")
    newest = F.max_by(F.struct("file_no", "seq", "op", "value"), F.struct("file_no", "seq")).alias("v")
    return log.join(hit, [*KEY, "file_no"]).groupBy(*KEY).agg(newest).select(*KEY, "v.file_no", "v.seq", (F.col("v.op") == 1).alias("deleted"), "v.value")


LEVEL1 = ", L1 AS (SELECT cf, CAST(CAST(user_key AS BIGINT) // 16 AS BIGINT) AS file_number, min(user_key) AS smallest_key, max(user_key) AS largest_key FROM L GROUP BY 1, 2)"


@query("SELECT P.cf, P.user_key, file_number FROM P JOIN L1 ON P.cf = L1.cf AND P.user_key BETWEEN smallest_key AND largest_key", L + PROBES + LEVEL1)
def sorted_level_probe(log, spark, sf_dir):
    """Disjoint files: each probe meets one at most."""
    level = log.groupBy("cf", F.expr("CAST(user_key AS BIGINT) div 16").alias("file_number")).agg(F.min("user_key").alias("smallest_key"), F.max("user_key").alias("largest_key"))
    return files.candidates(_probes(log), level).select(*KEY, "file_number")


@query(f"SELECT file_no, cf, user_key, seq, op, value FROM L WHERE file_no = 3 AND user_key = '{POINT}'")
def file_get(log, spark, sf_dir):
    return log.where((F.col("file_no") == 3) & (F.col("user_key") == POINT)).select("file_no", *KEY, "seq", "op", "value")


@query(f"SELECT cf, file_no, smallest_key, largest_key FROM F WHERE largest_key >= '{LOW}' AND smallest_key < '{HIGH}'", FILES)
def files_overlapping_range(log, spark, sf_dir):
    return files.overlapping(flush_l0(log, spark, sf_dir), LOW, HIGH).select("cf", "file_no", "smallest_key", "largest_key")


BLOCKS = """, B AS (SELECT cf, file_no, user_key, length(user_key) + 8 + CASE WHEN op = 0 THEN 8 ELSE 0 END AS bytes, seq FROM L),
C AS (SELECT *, CAST((sum(bytes) OVER (PARTITION BY cf, file_no ORDER BY user_key, seq DESC) - bytes) // 4096 AS BIGINT) AS block_no FROM B),
I AS (SELECT cf, file_no, block_no, count(*) AS num_entries, min(user_key) AS first_key, max(user_key) AS last_key, CAST(sum(bytes) AS BIGINT) AS block_bytes FROM C GROUP BY 1, 2, 3)"""


@query("SELECT * FROM I", L + BLOCKS)
def block_index(log, spark, sf_dir):
    return files.blocks(log, ["cf", "file_no"])


@query(
    """SELECT cf, file_no, count(*) AS num_entries, CAST(sum(CASE WHEN op = 0 THEN 8 ELSE 0 END) AS BIGINT) AS data_size, any_value(index_size) AS index_size,
       CAST((greatest(count(DISTINCT user_key) * 10, 64) + 7) // 8 + 1 AS BIGINT) AS filter_size, max(seq) AS max_sequence, min(user_key) AS smallest_key, max(user_key) AS largest_key
FROM L JOIN (SELECT cf, file_no, CAST(sum(length(last_key) + 16) AS BIGINT) AS index_size FROM I GROUP BY 1, 2) USING (cf, file_no) GROUP BY cf, file_no""",
    L + BLOCKS,
)
def table_properties(log, spark, sf_dir):
    """index_size: a key and a handle of 16 bytes for each block; filter_size: a Bloom filter of 10 bits a key and its number of hashes."""
    size = F.sum(F.when(F.col("op") == 0, 8).otherwise(0)).alias("data_size")
    index = files.blocks(log, ["cf", "file_no"]).groupBy("cf", "file_no").agg(F.sum(F.octet_length("last_key") + 16).alias("index_size"))
    keys = log.groupBy("cf", "file_no", "user_key").agg(F.count("*").alias("n"), size, F.max("seq").alias("seq"))
    own = keys.groupBy("cf", "file_no").agg(F.sum("n").alias("num_entries"), F.sum("data_size").alias("data_size"), (codec.bloom_bits(F.count("*"), 10) / 8 + 1).cast("long").alias("filter_size"), F.max("seq").alias("max_sequence"), F.min("user_key").alias("smallest_key"), F.max("user_key").alias("largest_key"))
    return own.join(index, ["cf", "file_no"])


@query(f"SELECT cf, file_no, min(block_no) AS block_no FROM I WHERE last_key >= '{HIGH}' GROUP BY cf, file_no", L + BLOCKS)
def block_lookup(log, spark, sf_dir):
    return files.blocks(log, ["cf", "file_no"]).where(F.col("last_key") >= HIGH).groupBy("cf", "file_no").agg(F.min("block_no").alias("block_no"))


@query("SELECT cf, file_no, user_key, seq, previous_key FROM (SELECT *, lag(user_key) OVER (PARTITION BY cf, file_no ORDER BY seq) AS previous_key FROM L) WHERE previous_key >= user_key")
def key_order_violations(log, spark, sf_dir):
    return files.order_violations(log).select("cf", "file_no", "user_key", "seq", "previous_key")


@query("SELECT cf, user_key, seq, op, value FROM L WHERE file_no = 5")
def sst_scan(log, spark, sf_dir):
    return log.where("file_no = 5").select(*KEY, "seq", "op", "value").orderBy(*KEY, F.desc("seq"))


# compaction and merging ---------------------------------------------------------------------------------------------


@query("SELECT cf, user_key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, user_key ORDER BY seq DESC) AS r FROM L WHERE file_no <= 4) WHERE r = 1")
def compact_l0_l1(log, spark, sf_dir):
    return compaction.compact(log.where("file_no <= 4"))


@query(f"SELECT cf, user_key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, user_key ORDER BY seq DESC) AS r FROM L WHERE user_key >= '{LOW}' AND user_key < '{HIGH}') WHERE r = 1")
def compact_range(log, spark, sf_dir):
    return compaction.compact(log.where((F.col("user_key") >= LOW) & (F.col("user_key") < HIGH)))


@query(
    """, S AS (SELECT *, CASE WHEN seq <= 2500 THEN 0 WHEN seq <= 6000 THEN 1 ELSE 2 END AS s FROM L),
T AS (SELECT *, row_number() OVER (PARTITION BY cf, user_key, s ORDER BY seq DESC) AS r FROM S)
SELECT cf, user_key, seq, op, value FROM T WHERE r = 1 AND NOT (op = 1 AND s = 0)"""
)
def compact_bottom(log, spark, sf_dir):
    return compaction.compact(log, list(LATE), bottom=True)


@query("SELECT cf, user_key, seq, op, value FROM N", NEW)
def dedup_versions(log, spark, sf_dir):
    return visibility.newest(log)


@query("SELECT cf, user_key, seq FROM N WHERE op = 1", NEW)
def tombstone_gc(log, spark, sf_dir):
    """What a compaction of everything to the bottom level may forget."""
    return visibility.newest(log).where("op = 1").select(*KEY, "seq")


@query("SELECT cf, count(*) AS num_files, count(*) >= 4 AS compact FROM F GROUP BY cf", FILES)
def compaction_trigger(log, spark, sf_dir):
    return flush_l0(log, spark, sf_dir).groupBy("cf").agg(F.count("*").alias("num_files"), (F.count("*") >= 4).alias("compact"))


OPERANDS = ", D AS (SELECT cf, user_key, max(seq) AS cut FROM L WHERE op = 1 GROUP BY 1, 2), O AS (SELECT L.* FROM L LEFT JOIN D USING (cf, user_key) WHERE op = 0 AND (cut IS NULL OR seq > cut))"


@query("SELECT cf, user_key, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n_operands FROM O GROUP BY 1, 2", L + OPERANDS)
def merge_sum(log, spark, sf_dir):
    return compaction.merge_sum(log)


CENTS = "CAST(round(value * 100) AS BIGINT)"


@query(f"SELECT cf, user_key, string_agg(CAST({CENTS} AS VARCHAR), ',' ORDER BY seq) AS appended FROM O GROUP BY 1, 2", L + OPERANDS)
def merge_append(log, spark, sf_dir):
    return compaction.merge_append(log.withColumn("value", F.round(F.col("value") * 100).cast("long").cast("string")))


@query(f"SELECT cf, user_key, CAST(list_reduce(list_prepend(CAST(7 AS BIGINT), list({CENTS} ORDER BY seq)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS folded FROM O GROUP BY 1, 2", L + OPERANDS)
def merge_fold(log, spark, sf_dir):
    return compaction.merge_fold(log.withColumn("value", F.round(F.col("value") * 100).cast("long")), F.lit(7).cast("long"), lambda a, x: (a * 31 + x) % 1000003)


@query(
    f""", Q AS (SELECT *, {CENTS} AS cents, CASE WHEN seq <= 2500 THEN 0 WHEN seq <= 6000 THEN 1 ELSE 2 END AS s FROM L),
D AS (SELECT cf, user_key, s, max(seq) AS cut FROM Q WHERE op = 1 GROUP BY 1, 2, 3)
SELECT cf, user_key, cut AS seq, 1 AS op, NULL AS value FROM D WHERE s > 0
UNION ALL SELECT cf, user_key, max(seq), 0, string_agg(CAST(cents AS VARCHAR), ',' ORDER BY seq) FROM Q LEFT JOIN D USING (cf, user_key, s) WHERE op = 0 AND (cut IS NULL OR seq > cut) GROUP BY cf, user_key, s"""
)
def compact_merged(log, spark, sf_dir):
    """A bottom compaction of a family whose values append: each stripe's puts become one, after the tombstone that cuts off older ones."""
    comma = lambda a, b: F.concat(a, F.lit(","), b)
    listed = log.withColumn("value", F.round(F.col("value") * 100).cast("long").cast("string"))
    return compaction.compact(listed, list(LATE), bottom=True, merge=compaction.MergeOperator("list", comma, join=comma))


# catalog ------------------------------------------------------------------------------------------------------------


def _edits(log: DataFrame) -> DataFrame:
    return edit_log(files.file_stats(log, ["cf", "file_no"]))


LIVE = """, X AS (SELECT *, row_number() OVER (PARTITION BY cf, level, file_number ORDER BY edit_id DESC, CASE WHEN kind = 'add_file' THEN 1 ELSE 0 END DESC) AS r FROM E WHERE kind IN ('add_file', 'delete_file')),
Y AS (SELECT cf, level, file_number, smallest_key, largest_key, file_size FROM X WHERE r = 1 AND kind = 'add_file')"""


@query("SELECT edit_id, cf, kind, level, file_number, smallest_key, largest_key, file_size, cf_name, next_file_number, last_sequence FROM E", EDITS)
def manifest_replay(log, spark, sf_dir):
    return _edits(log).orderBy("edit_id")


@query("SELECT * FROM Y", EDITS + LIVE)
def live_files(log, spark, sf_dir):
    return files.live_files(_edits(log))


@query("SELECT max(next_file_number) AS next_file_number, max(last_sequence) AS last_sequence, max(edit_id) AS last_edit, count(*) AS num_edits FROM E", EDITS)
def manifest_counters(log, spark, sf_dir):
    return files.counters(_edits(log))


@query("SELECT cf, level, count(*) AS num_files, CAST(sum(file_size) AS BIGINT) AS bytes, min(smallest_key) AS smallest_key, max(largest_key) AS largest_key FROM Y GROUP BY cf, level", EDITS + LIVE)
def level_summary(log, spark, sf_dir):
    return files.live_files(_edits(log)).groupBy("cf", "level").agg(F.count("*").alias("num_files"), F.sum("file_size").alias("bytes"), F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"))


@query("SELECT cf, cf_name, kind = 'drop_cf' AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY cf ORDER BY edit_id DESC) AS r FROM E WHERE kind IN ('add_cf', 'drop_cf')) WHERE r = 1", EDITS)
def cf_catalog(log, spark, sf_dir):
    return files.families(_edits(log))


# the log ------------------------------------------------------------------------------------------------------------


@query("SELECT seq, cf, user_key, op, v AS value FROM T WHERE batch_id % 10 <> 3", L + ENCODED)
def wal_replay(log, spark, sf_dir):
    """Replay records of which some lost their last bytes: a batch is replayed whole or not at all."""
    torn = F.when(F.col("batch_id") % 10 == 3, F.substring("record", F.lit(1), F.octet_length("record") - 3)).otherwise(F.col("record"))
    found = wal.entries(_records(log).select(torn.alias("record")))
    return found.select("seq", "cf", F.col("user_key").cast("string").alias("user_key"), "op", F.col("value").cast("string").alias("value")).orderBy("seq")


@query("SELECT doc_id // 64 AS log, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) - 1 AS ordinal, sha256(coalesce(text, '')) AS record_sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents", "")
def wal_read_back(log, spark, sf_dir):
    """Write long records as the fragments of log files, and read the files' bytes: checksums are tested, fragments joined."""
    docs = table(spark, sf_dir, "documents")
    records = docs.select(F.expr("doc_id div 64").alias("log"), F.col("doc_id").alias("ordinal"), F.coalesce("text", F.lit("")).cast("binary").alias("record"))
    return wal.unframed(wal.framed(records)).select("log", "ordinal", F.sha2("record", 256).alias("record_sha256"), F.octet_length("record").cast("long").alias("n_bytes"))


@query(
    """SELECT doc_id, n AS record_bytes, greatest(1, (n + 32760) // 32761) AS n_fragments, n + 7 * greatest(1, (n + 32760) // 32761) AS framed_bytes,
       n - 32761 * (greatest(1, (n + 32760) // 32761) - 1) AS last_fragment_bytes, CASE WHEN n <= 32761 THEN 'full' ELSE 'first..last' END AS shape
FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents)""",
    "",
)
def wal_fragments(log, spark, sf_dir):
    n, parts = F.col("record_bytes"), codec.wal_fragments(F.col("record_bytes"))
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("record_bytes"))
    room = codec.BLOCK_BYTES - codec.HEADER_BYTES
    return sizes.select("doc_id", "record_bytes", parts.alias("n_fragments"), (n + codec.HEADER_BYTES * parts).alias("framed_bytes"), (n - room * (parts - 1)).alias("last_fragment_bytes"), F.when(n <= room, "full").otherwise("first..last").alias("shape"))


@query(", B AS (SELECT batch_id, max(seq) - 50 * (batch_id % 3) AS pending_seq FROM L GROUP BY batch_id) SELECT batch_id, pending_seq, max(pending_seq) OVER (ORDER BY batch_id) AS synced_seq FROM B")
def durable_watermark(log, spark, sf_dir):
    """Sync notices may come late; the durable sequence number never goes back."""
    notices = log.groupBy("batch_id").agg(F.max("seq").alias("m")).select("batch_id", (F.col("m") - 50 * (F.col("batch_id") % 3)).alias("pending_seq"))
    return running(notices, [], "batch_id", "pending_seq", "synced_seq", "max")


BYTES = "list_transform(string_split({}, ''), lambda c: CAST(unicode(c) AS BIGINT))"


@query(
    f""", C AS (SELECT seq, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {BYTES.format("chr(1) || user_key || CAST(seq AS VARCHAR)")}),
       lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END))) AS crc FROM L)
SELECT seq, crc, ((crc // 32768) + (crc % 32768) * 131072 + 2726488792) % 4294967296 AS masked FROM C"""
)
def record_checksum(log, spark, sf_dir):
    """IEEE CRC-32 over the record type and the payload, and its masked form."""
    crc = F.crc32(F.concat(F.char(F.lit(1)), F.col("user_key"), F.col("seq").cast("string")))
    return log.select("seq", crc.alias("crc"), codec.crc_mask(crc).alias("masked"))


# codecs and filters -------------------------------------------------------------------------------------------------


@query("SELECT seq, seq * 256 + op AS tag, seq AS seq_back, op AS op_back FROM L")
def internal_key_tag(log, spark, sf_dir):
    tag = codec.key_tag(F.col("seq"), F.col("op"))
    return log.select("seq", tag.alias("tag"), codec.tag_seq(tag).alias("seq_back"), codec.tag_op(tag).alias("op_back"))


@query(f"SELECT seq, seq * seq AS v, CASE {' '.join(f'WHEN seq * seq < {1 << 7 * n} THEN {n}' for n in range(1, 9))} ELSE 9 END AS varint_bytes FROM L")
def varint_length(log, spark, sf_dir):
    v = F.col("seq") * F.col("seq")
    return log.select("seq", v.alias("v"), codec.varint_length(v).alias("varint_bytes"))


@query("SELECT seq, printf('%02x%02x%02x%02x', seq % 256, (seq // 256) % 256, (seq // 65536) % 256, (seq // 16777216) % 256) AS fixed32, length(user_key) + 1 AS prefixed_bytes FROM L")
def fixed_encoding(log, spark, sf_dir):
    return log.select("seq", codec.fixed_hex(F.col("seq"), 4).alias("fixed32"), codec.length_prefixed_bytes(F.col("user_key")).cast("long").alias("prefixed_bytes"))


PREFIXES = """O AS (SELECT cf, user_key, row_number() OVER (PARTITION BY cf ORDER BY encode(user_key)) - 1 AS entry, lag(user_key) OVER (PARTITION BY cf ORDER BY encode(user_key)) AS b FROM K),
S AS (SELECT cf, user_key, entry, CASE WHEN entry % 16 = 0 OR b IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(user_key), length(b)) + 1), lambda i: user_key[1:i] = b[1:i])) END AS shared FROM O)
SELECT cf, user_key, entry, CAST(shared AS INT) AS shared, CAST(strlen(user_key) - shared AS INT) AS non_shared FROM S"""


@query(f", K AS (SELECT DISTINCT cf, user_key FROM L), {PREFIXES}")
def prefix_compression(log, spark, sf_dir):
    out = files.shared_prefixes(log.select(*KEY).distinct())
    return out.select("cf", "user_key", F.col("entry").cast("long").alias("entry"), "shared", "non_shared")


@query(f"WITH K AS (SELECT DISTINCT CAST(page_id % 2 AS INT) AS cf, url AS user_key FROM pages WHERE url IS NOT NULL), {PREFIXES}", "")
def prefix_compression_urls(log, spark, sf_dir):
    """The same for keys of mixed length."""
    keys = table(spark, sf_dir, "pages").where("url is not null").select((F.col("page_id") % 2).cast("int").alias("cf"), F.col("url").alias("user_key"))
    return files.shared_prefixes(keys.distinct()).select("cf", "user_key", F.col("entry").cast("long").alias("entry"), "shared", "non_shared")


@query("SELECT DISTINCT file_no, printf('%06d.sst', file_no) AS sst, printf('%06d.log', file_no) AS wal, printf('MANIFEST-%06d', file_no) AS manifest FROM L")
def file_names(log, spark, sf_dir):
    n = F.col("file_no")
    return log.select("file_no").distinct().select("file_no", codec.file_name(n, "sst").alias("sst"), codec.file_name(n, "log").alias("wal"), F.format_string("MANIFEST-%06d", n).alias("manifest"))


@query("SELECT cf, file_no, n, CAST((greatest(n * 10, 64) + 7) // 8 * 8 AS BIGINT) AS bits, CAST((greatest(n * 10, 64) + 7) // 8 + 1 AS BIGINT) AS bytes, 7 AS k FROM (SELECT cf, file_no, count(DISTINCT user_key) AS n FROM L GROUP BY 1, 2)")
def bloom_parameters(log, spark, sf_dir):
    n = log.select("cf", "file_no", "user_key").distinct().groupBy("cf", "file_no").agg(F.count("*").alias("n"))
    bits = codec.bloom_bits(F.col("n"), 10)
    return n.select("cf", "file_no", "n", bits.alias("bits"), (bits / 8 + 1).cast("long").alias("bytes"), F.lit(codec.bloom_hashes(10)).alias("k"))


BLOOM = f""", K AS (SELECT DISTINCT cf, file_no, user_key, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {BYTES.format("user_key")}), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS h FROM L),
H AS (SELECT *, (h // 131072) + (h * 32768) % 4294967296 AS d FROM K), Z AS (SELECT cf, file_no, (greatest(count(*) * 10, 64) + 7) // 8 * 8 AS bits FROM K GROUP BY 1, 2),
U AS (SELECT H.cf, H.file_no, user_key, unnest(list_transform(range(7), lambda i: ((h + i * d) % 4294967296) % bits)) AS place FROM H JOIN Z USING (cf, file_no)), B AS (SELECT DISTINCT cf, file_no, place FROM U),
A AS (SELECT H.cf, Z.file_no, H.file_no AS origin, user_key, unnest(list_transform(range(7), lambda i: ((h + i * d) % 4294967296) % bits)) AS place FROM H JOIN Z ON H.cf = Z.cf AND Z.file_no IN (H.file_no, H.file_no + 1)),
M AS (SELECT A.cf, A.file_no, origin = A.file_no AS own, user_key, bool_and(B.place IS NOT NULL) AS hit FROM A LEFT JOIN B ON A.cf = B.cf AND A.file_no = B.file_no AND A.place = B.place GROUP BY 1, 2, 3, 4)"""


@query("SELECT cf, file_no, count(*) FILTER (own) AS own_keys, count(*) FILTER (own AND hit) AS own_hits, count(*) FILTER (NOT own) AS other_keys, count(*) FILTER (NOT own AND hit) AS other_hits FROM M GROUP BY cf, file_no", L + BLOOM)
def bloom_probe(log, spark, sf_dir):
    """Build the filters of all files; ask each about its own keys, which it must let through, and about those of the file before."""
    by, bloom = ["cf", "file_no"], BloomFilter(10)
    keys = log.select(*by, "user_key").distinct()
    filters = bloom.build(keys, by)
    probes = keys.withColumn("own", F.lit(True)).unionAll(keys.select("cf", (F.col("file_no") + 1).alias("file_no"), "user_key", F.lit(False)).join(filters.select(*by).distinct(), by, "left_semi"))
    hits = bloom.may_match(probes, filters, by).withColumn("hit", F.lit(1))
    asked = probes.join(hits, [*by, "user_key"], "left")
    count = lambda own, what: F.count(F.when(F.col("own") == own, F.col(what)))
    return asked.groupBy(*by).agg(count(True, "user_key").alias("own_keys"), count(True, "hit").alias("own_hits"), count(False, "user_key").alias("other_keys"), count(False, "hit").alias("other_hits"))


@query("SELECT seq, CAST(xor(CAST(file_no AS BIGINT), (CAST(seq AS BIGINT) * 4096) * 131072) & 15 AS INT) AS shard FROM L")
def cache_shards(log, spark, sf_dir):
    return log.select("seq", cache.shard_of(F.col("file_no"), F.col("seq") * 4096).alias("shard"))


@query(
    """, A AS (SELECT seq AS t, CAST(file_no % 16 AS INT) AS shard, file_no * 1000 + CAST(user_key AS BIGINT) % 50 AS block FROM L),
P AS (SELECT *, lag(t) OVER (PARTITION BY shard, block ORDER BY t) AS before FROM A),
H AS (SELECT P.shard, P.t, P.before IS NOT NULL AND (SELECT count(DISTINCT A.block) FROM A WHERE A.shard = P.shard AND A.t > P.before AND A.t < P.t) < 20 AS hit FROM P)
SELECT shard, count(*) AS accesses, count(*) FILTER (hit) AS hits, greatest(count(*) FILTER (NOT hit) - 20, 0) AS evictions FROM H GROUP BY shard"""
)
def cache_simulation(log, spark, sf_dir):
    """Reads of 50 blocks of each file through shards of 20 blocks."""
    return cache.simulate(log.select(F.col("seq").alias("at"), "file_no", (F.col("user_key").cast("long") % 50 * 4096).alias("offset")), 20)


@query(
    """, C AS (SELECT event_id AS n, event_type AS t, printf('%012d', user_id % 40) AS key, props FROM events),
S AS (SELECT n, key, props FROM C WHERE t NOT IN ('signup', 'view')), W AS (SELECT C.n, C.t, C.key, S.props AS v, CAST(octet_length(encode(S.props)) AS VARCHAR) AS len FROM C ASOF LEFT JOIN (SELECT n AS sn, key, replace(props, ' ', '') AS props FROM S) S ON C.key = S.key AND C.n > S.sn)
SELECT n, CASE t WHEN 'signup' THEN '+PONG' || chr(13) || chr(10) WHEN 'view' THEN CASE WHEN v IS NULL THEN '$-1' || chr(13) || chr(10) ELSE '$' || len || chr(13) || chr(10) || v || chr(13) || chr(10) END ELSE '+OK' || chr(13) || chr(10) END AS reply FROM W"""
)
def command_replies(log, spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.format_string("%012d", F.col("user_id") % 40)
    text = F.when(F.col("event_type") == "signup", "ping").when(F.col("event_type") == "view", F.concat(F.lit("GET "), key)).otherwise(F.concat(F.lit("set "), key, F.lit(" "), F.regexp_replace("props", " ", "")))
    return commands.replies(e.select(F.col("event_id").alias("n"), text.alias("command")))
