"""Queries over the supplied tables, with the SQL that gives the same rows.

None of the tables holds music: documents, conversations and labels stand in for prompts and ids, events packed by user for
token sequences, and events of a user for outcomes of a prompt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.text import file_kind, output_path, prompt_directory, prompt_stamp, session_stamp, swapped_suffix, templated
from tessitura.functions.tokens import all_allowed, limited, peak, shifted, unshifted, with_begin, without_prompt
from tessitura.operators.matching import matched, split
from tessitura.operators.audio import gated_rows, sounding
from tessitura.operators.midi import midi_notes, with_midi
from tessitura.operators.sampling import sampled
from tessitura.operators.notes import checked, density_of_rows, event_tokens, from_events, notes_per_time, unpacked
from tessitura.operators.statistics import failures_as_requested, output_files, run_statistics, run_times
from tessitura.sources.files import generation_files
from tessitura.sources.prompts import ids_in, ingested

PREFIX = "Describe the music: "


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(_table(spark, sf_dir, "events"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as outputs of a prompt: errors fail, purchases are audio files."""
    kind = F.when(F.col("event_type") == "purchase", "mp3").otherwise("mid")
    return _table(spark, sf_dir, "events").select(
        (F.col("user_id") + 1).alias("prompt_idx"),
        F.col("event_id").alias("output_idx"),
        (F.col("user_id") % 7 + 60).alias("requested"),
        F.col("value").alias("secs"),
        (F.col("event_type") != "error").alias("ok"),
        F.format_string("u%d/gen_%d.%s", F.col("user_id"), F.col("event_id"), kind).alias("path"),
    )


def prompt_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped, non-blank prompts; half of the texts are padded with white space of several scripts first."""
    docs = _table(spark, sf_dir, "documents")
    padded = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\t  "), F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")), F.lit("\u0085\u001c\u001f "))).otherwise(F.col("text"))
    return ingested(docs.select("doc_id", padded.alias("text")), "doc_id", "text")


def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", templated(F.col("text"), PREFIX).alias("full_prompt"))


def token_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted ids with the sequence mark, and back again."""
    rows = _sequences(spark, sf_dir).select("seq_id", with_begin(shifted(F.col("tokens"))).alias("ids"))
    both = rows.select("seq_id", "ids", unshifted(F.col("ids")).alias("back"))
    return both.select("seq_id", F.posexplode(F.arrays_zip("ids", "back")).alias("pos", "x")).select("seq_id", F.col("pos").cast("long").alias("pos"), F.col("x.ids").cast("long").alias("shifted_id"), F.col("x.back").cast("long").alias("token"))


def prompt_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the first half of each sequence, as if that were the prompt."""
    rows = _sequences(spark, sf_dir)
    given = F.slice("tokens", 1, F.floor(F.size("tokens") / 2).cast("int"))
    left = without_prompt(F.col("tokens"), given)
    return rows.select("seq_id", F.size(left).cast("long").alias("n_left"), F.array_join(left.cast("array<string>"), ",").alias("left_ids"))


def allowed_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all ids are music ids; the notes of every 97th event are made negative."""
    events = _table(spark, sf_dir, "events")
    odd = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("event_id") % 97 == 0, -F.col("event_id") - 1).otherwise(11000 + (F.col("event_id") * 7) % 16512))).alias("tokens"))
    return odd.select(F.col("user_id").alias("seq_id"), F.size("tokens").cast("long").alias("n"), all_allowed(F.col("tokens")).alias("allowed"))


def triple_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples, after the last id of every third sequence is cut off."""
    cut = F.when(F.col("seq_id") % 3 == 0, F.slice("tokens", 1, F.size("tokens") - 1)).otherwise(F.col("tokens"))
    rows = unpacked(_sequences(spark, sf_dir).select("seq_id", cut.alias("tokens")))
    return rows.select("seq_id", "pos", *(F.col(c).cast("long").alias(c) for c in ("time", "dur", "note")))


def count_per_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_per_time(_sequences(spark, sf_dir)).select("seq_id", F.col("time").cast("long").alias("time"), "n")


def _density(limit: int):
    def density_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
        return density_of_rows(event_tokens(_table(spark, sf_dir, "events")), limit)

    return density_flag


def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_statistics(_outcomes(spark, sf_dir))


def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures_as_requested(_outcomes(spark, sf_dir))


def output_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output_files(_outcomes(spark, sf_dir), "prompt_idx")


def output_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each output's kind, its audio path and its directory."""
    rows = _outcomes(spark, sf_dir)
    return rows.select("output_idx", file_kind(F.col("path")).alias("kind"), swapped_suffix(F.col("path"), ".mp3").alias("audio_path"), prompt_directory("20240101_000000", F.col("prompt_idx")).alias("directory"))


def wave_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings times 4 as waveforms: their peak, and that after limiting."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4).alias("w"))
    return rows.select("vec_id", F.round(peak(F.col("w")), 6).alias("peak"), F.round(peak(limited(F.col("w"))), 6).alias("limited_peak"))


def text_id_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), _table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id")


def density_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statuses: of every five sequences one is emptied, one has its second time made negative, one its first duration."""
    rows = _sequences(spark, sf_dir)
    made = F.transform("tokens", lambda x, i: F.when((F.col("seq_id") % 5 == 1) & (i == 3) | (F.col("seq_id") % 5 == 2) & (i == 1), -x - 1).otherwise(x))
    rows = rows.select("seq_id", F.when(F.col("seq_id") % 5 == 0, F.slice("tokens", 1, 0)).otherwise(made).alias("tokens"))
    return checked(rows, 7).select("seq_id", "status", "ok")


def stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a run as JSON text."""
    return run_statistics(_outcomes(spark, sf_dir)).select(F.to_json(F.struct("total_prompts", "successful_generations", "failed_generations")).alias("stats"))


def midi_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence's MIDI file, as hexadecimal digits."""
    rows = with_midi(_sequences(spark, sf_dir))
    return rows.select("seq_id", F.length("midi").cast("long").alias("n_bytes"), F.hex("midi").alias("midi_hex"))


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run would write, by name, size and digest: three prompts share a directory, and crowded sequences leave nothing."""
    group = (F.col("seq_id") % 3).alias("prompt_idx")
    rows = with_midi(checked(_sequences(spark, sf_dir), 7)).select(group, F.col("seq_id").alias("output_idx"), "tokens", "midi", "ok")
    rows = rows.withColumn("directory", prompt_directory("20240101_000000", F.col("prompt_idx"))).withColumn("prompt", F.concat(F.lit("caf\u00e9 "), "prompt_idx"))
    return generation_files(rows).select("path", F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings times 3 as logits, a step of its own for each vector of a label."""
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").alias("seq_id"), F.col("vec_id").alias("step"), F.transform("embedding", lambda x: x.cast("double") * 3).alias("logits"))


def nucleus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id for each step, by temperature 0.7 and top-p 0.9; of five ids one isn't allowed."""
    rows = sampled(_steps(spark, sf_dir), "music", 0.7, 0.9, lambda i: i % 5 != 3)
    return rows.select("seq_id", "step", F.col("token").cast("long").alias("token"), F.round("p", 6).alias("p"), F.col("n_kept").cast("long").alias("n_kept"))


def sounding_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as waveforms: what stays of each when silence, 6 decibels below the loudest frame, is cut off at both ends."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("i", "x"))
    found = sounding(rows, 6.0, 8, 2)
    return found.select(F.col("id").alias("vec_id"), *(F.col(c).cast("long").alias(c) for c in ("n", "start", "end")))


def gated_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings' squares as blocks of a recording for each label, every hundredth almost silent."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.posexplode("embedding").alias("i", "x"))
    x = F.col("x").cast("double")
    found = gated_rows(rows.select("id", (x * x * F.when(F.col("i") % 100 == 99, 1e-9).otherwise(1.0)).alias("power")))
    return found.select(F.col("id").alias("label"), "n_blocks", "n_gated", F.round("loudness", 6).alias("loudness"))


def midi_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes in each sequence's MIDI file."""
    files = with_midi(_sequences(spark, sf_dir)).select(F.col("seq_id").cast("string").alias("path"), F.col("midi").alias("content"))
    return midi_notes(files).select(F.col("path").cast("long").alias("seq_id"), *(F.col(c).cast("long").alias(c) for c in ("time", "dur", "note")))


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each event's output would lie: its session's folder, its prompt's directory and its file, by time and user."""
    rows = _table(spark, sf_dir, "events")
    directory = prompt_directory(prompt_stamp(F.col("ts")), F.col("user_id") + 1)
    return rows.select("event_id", F.concat_ws("/", session_stamp(F.col("ts")), output_path(directory, F.col("event_id"))).alias("path"))


def evaluation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of documents as lines of an id file: some in capitals, some padded, some cut off, some longer."""
    k, own = F.col("doc_id"), F.md5("text")
    line = F.when(k % 7 == 1, F.upper(own)).when(k % 7 == 2, F.concat(F.lit("\t"), own, F.lit("\u2003\r"))).when(k % 7 == 3, F.substring(own, 1, 31)).when(k % 7 == 4, F.concat(own, F.lit("0"))).otherwise(own)
    return ids_in(_table(spark, sf_dir, "documents").select(line.alias("value")))


def session_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seconds that each user's events take, from the first one's beginning to the last end."""
    rows = _table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("began"), F.col("value").alias("secs"))
    return run_times(rows, "user_id").select("user_id", F.round("total_time", 3).alias("total_time"))


def validation_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and rejected sequences with the density rule and without it."""
    rows = _sequences(spark, sf_dir)
    both = checked(rows, 7).withColumn("validated", F.lit(True)).union(checked(rows, 7, validate=False).withColumn("validated", F.lit(False)))
    return both.groupBy("validated", "status").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("rejected"))


QUERIES = {
    "density_flag_7": _density(7),
    "density_flag_64": _density(64),
    "notes_per_time": count_per_time,
    **{f.__name__: f for f in (prompt_ingest, prompt_template, token_shift, prompt_removed, allowed_vocab, triple_unpack, generation_stats, failure_counts, output_listing, output_kinds, wave_peak, text_id_match, eval_split, density_status, stats_json, midi_bytes, run_files, nucleus_sample, sounding_part, gated_loudness, midi_read_back, output_paths, evaluation_ids, session_times, validation_switch)},
}

_PACKED = """
e AS (SELECT user_id AS seq_id, event_id, hour(ts) AS h, row_number() OVER (PARTITION BY user_id ORDER BY hour(ts), event_id) AS k FROM events),
tok AS (SELECT seq_id, 3 * (k - 1) + j AS pos, CASE j WHEN 0 THEN h WHEN 1 THEN 10000 + event_id % 1000 ELSE 11000 + (event_id * 7) % 16512 END AS token
        FROM e, (SELECT unnest([0, 1, 2]) AS j))"""
_OUTCOMES = """
o AS (SELECT user_id + 1 AS prompt_idx, event_id AS output_idx, user_id % 7 + 60 AS requested, value AS secs, event_type <> 'error' AS ok,
      'u' || user_id || '/gen_' || event_id || CASE WHEN event_type = 'purchase' THEN '.mp3' ELSE '.mid' END AS path FROM events)"""

_MIDI = f"""{_PACKED},
note AS (SELECT seq_id, k, h, greatest(1, event_id % 1000) AS ticks, (event_id * 7) % 16512 // 128 AS i, (event_id * 7) % 16512 % 128 AS pitch FROM e),
chan AS (SELECT seq_id, i, CASE WHEN i = 128 THEN 9 ELSE [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15][1 + (row_number() OVER (PARTITION BY seq_id, i = 128 ORDER BY min(k)) - 1) % 15] END AS c
         FROM note GROUP BY seq_id, i),
ev AS (SELECT seq_id, i, 0 AS tick, 0 AS kind, format('{{:02X}}{{:02X}}', 192 + c, i) AS m FROM chan WHERE i < 128
       UNION ALL SELECT seq_id, i, h, 2, format('{{:02X}}{{:02X}}5A', 144 + c, pitch) FROM note JOIN chan USING (seq_id, i)
       UNION ALL SELECT seq_id, i, h + ticks, 1, format('{{:02X}}{{:02X}}00', 128 + c, pitch) FROM note JOIN chan USING (seq_id, i)),
step AS (SELECT seq_id, i, m, row_number() OVER own AS r, tick - lag(tick, 1, 0) OVER own AS d FROM ev WINDOW own AS (PARTITION BY seq_id, i ORDER BY tick, kind, m)),
track AS (SELECT seq_id, i, string_agg(CASE WHEN d < 128 THEN format('{{:02X}}', d) ELSE format('{{:02X}}{{:02X}}', 128 + d // 128, d % 128) END || m, '' ORDER BY r) || '00FF2F00' AS body
          FROM step GROUP BY seq_id, i),
midi AS (SELECT seq_id, '4D546864000000060001' || format('{{:04X}}', 1 + count(*)) || '0032' || '4D54726B0000000B00FF510307A12000FF2F00'
                || string_agg('4D54726B' || format('{{:08X}}', length(body) // 2) || body, '' ORDER BY i) AS midi_hex FROM track GROUP BY seq_id)"""


#: The code points that Python's str.isspace holds for, written out so that the SQL doesn't rest on the code it checks.
_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _density_sql(limit: int) -> str:
    return f"""
WITH {_PACKED},
c AS (SELECT seq_id, token, count(*) AS n FROM tok WHERE pos % 3 = 0 GROUP BY ALL)
SELECT seq_id, CAST(3 * sum(n) AS BIGINT) AS n_tokens, CASE WHEN max(n) > {limit} THEN 'excessive' ELSE 'pass' END AS status, max(n) <= {limit} AS ok
FROM c GROUP BY seq_id"""


SQL = {
    "density_flag_7": _density_sql(7),
    "density_flag_64": _density_sql(64),
    "notes_per_time": f"WITH {_PACKED} SELECT seq_id, CAST(token AS BIGINT) AS time, count(*) AS n FROM tok WHERE pos % 3 = 0 GROUP BY ALL",
    "prompt_ingest": rf"""
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(9) || chr(160) || chr(8195) || CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END || chr(133) || chr(28) || chr(31) || ' ' ELSE text END AS t FROM documents)
SELECT doc_id, regexp_replace(t, '\A{_BLANK}+|{_BLANK}+\z', '', 'g') AS prompt FROM p WHERE regexp_replace(t, '\A{_BLANK}+|{_BLANK}+\z', '', 'g') <> ''""",
    "prompt_template": f"SELECT conv_id, turn, '{PREFIX}' || text || ' ' AS full_prompt FROM conversations",
    "token_shift": f"""
WITH {_PACKED}
SELECT seq_id, pos, CAST(token + 128256 AS BIGINT) AS shifted_id, CAST(token AS BIGINT) AS token FROM tok
UNION ALL SELECT seq_id, count(*), 183282, 55026 FROM tok GROUP BY seq_id""",
    "prompt_removed": f"""
WITH {_PACKED},
n AS (SELECT seq_id, count(*) AS n FROM tok GROUP BY seq_id)
SELECT seq_id, count(*) AS n_left, string_agg(CAST(token AS VARCHAR), ',' ORDER BY pos) AS left_ids FROM tok JOIN n USING (seq_id) WHERE pos >= n // 2 GROUP BY seq_id""",
    "allowed_vocab": """
SELECT user_id AS seq_id, count(*) AS n, bool_and(CASE WHEN event_id % 97 = 0 THEN -event_id - 1 ELSE 11000 + (event_id * 7) % 16512 END BETWEEN 0 AND 55025) AS allowed
FROM events GROUP BY user_id""",
    "triple_unpack": f"""
WITH {_PACKED},
n AS (SELECT seq_id, count(*) AS n FROM tok GROUP BY seq_id),
left_ AS (SELECT seq_id, pos, token FROM tok JOIN n USING (seq_id) WHERE pos < n - CASE WHEN seq_id % 3 = 0 THEN 1 ELSE 0 END)
SELECT seq_id, CAST(pos // 3 + 1 AS BIGINT) AS pos, CAST(max(CASE WHEN pos % 3 = 0 THEN token END) AS BIGINT) AS time,
       CAST(max(CASE WHEN pos % 3 = 1 THEN token END) AS BIGINT) AS dur, CAST(max(CASE WHEN pos % 3 = 2 THEN token END) AS BIGINT) AS note
FROM left_ GROUP BY seq_id, pos // 3""",
    "density_status": f"""
WITH {_PACKED},
m AS (SELECT seq_id, pos, CASE WHEN seq_id % 5 = 1 AND pos = 3 OR seq_id % 5 = 2 AND pos = 1 THEN -token - 1 ELSE token END AS token FROM tok),
c AS (SELECT seq_id, token, count(*) AS n FROM m WHERE pos % 3 = 0 GROUP BY ALL),
s AS (SELECT seq_id, CASE WHEN seq_id % 5 = 0 THEN 'error_empty' WHEN min(token) < 0 THEN 'error_negative' WHEN max(n) > 7 THEN 'excessive' ELSE 'pass' END AS status FROM c GROUP BY seq_id)
SELECT seq_id, status, status = 'pass' AS ok FROM s""",
    "stats_json": f"""
WITH {_OUTCOMES}
SELECT '{{"total_prompts":' || count(DISTINCT prompt_idx) || ',"successful_generations":' || count(*) FILTER (ok) || ',"failed_generations":' || count(*) FILTER (NOT ok) || '}}' AS stats FROM o""",
    "midi_bytes": f"WITH {_MIDI} SELECT seq_id, length(midi_hex) // 2 AS n_bytes, midi_hex FROM midi",
    "run_files": f"""
WITH {_MIDI},
c AS (SELECT seq_id, token, count(*) AS n FROM tok WHERE pos % 3 = 0 GROUP BY ALL),
good AS (SELECT seq_id, '20240101_000000_prompt_' || seq_id % 3 || '/' AS folder FROM c GROUP BY seq_id HAVING max(n) <= 7),
file AS (
  SELECT DISTINCT folder || 'prompt.txt' AS path, encode('caf' || chr(233) || ' ' || seq_id % 3) AS content FROM good
  UNION ALL SELECT any_value(folder) || 'gen_' || seq_id || '_tokens.txt', encode(string_agg(token, chr(10) ORDER BY pos) || chr(10)) FROM tok JOIN good USING (seq_id) GROUP BY seq_id
  UNION ALL SELECT folder || 'gen_' || seq_id || '.mid', unhex(midi_hex) FROM midi JOIN good USING (seq_id))
SELECT path, octet_length(content) AS n_bytes, sha256(content) AS sha256 FROM file""",
    "generation_stats": f"""
WITH {_OUTCOMES},
p AS (SELECT prompt_idx, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad, min(secs) AS secs FROM o GROUP BY prompt_idx)
SELECT count(*) AS total_prompts, CAST(sum(good) AS BIGINT) AS successful_generations, CAST(sum(bad) AS BIGINT) AS failed_generations,
       count(*) FILTER (prompt_idx > 1) AS timed_prompts, round(coalesce(avg(secs) FILTER (prompt_idx > 1), 0), 6) AS average_time FROM p""",
    "failure_counts": f"WITH {_OUTCOMES} SELECT prompt_idx, max(requested) - count(*) FILTER (ok) AS failed_generations FROM o GROUP BY prompt_idx",
    "output_listing": f"""
WITH {_OUTCOMES}
SELECT prompt_idx, string_agg(path, ',' ORDER BY output_idx, CASE WHEN path LIKE '%.mid' THEN 0 ELSE 1 END) AS files FROM o WHERE ok GROUP BY prompt_idx""",
    "output_kinds": f"""
WITH {_OUTCOMES}
SELECT output_idx, CASE WHEN path LIKE '%.mid' THEN 'MIDI' ELSE 'Audio' END AS kind, regexp_replace(path, '\\.mid$', '.mp3') AS audio_path,
       '20240101_000000_prompt_' || prompt_idx AS directory FROM o""",
    "wave_peak": """
WITH w AS (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE) * 4))) AS p FROM embeddings)
SELECT vec_id, round(coalesce(p, 0), 6) AS peak, round(CASE WHEN p > 1 THEN 1 ELSE coalesce(p, 0) END, 6) AS limited_peak FROM w""",
    "text_id_match": "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)",
    "eval_split": "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) THEN 'eval' ELSE 'train' END AS part FROM documents",
    "nucleus_sample": """
WITH x AS (SELECT label AS seq_id, vec_id AS step, id, CAST(embedding[id + 1] AS DOUBLE) * 3 AS x FROM (SELECT *, unnest(range(len(embedding))) AS id FROM embeddings) WHERE id % 5 <> 3),
w AS (SELECT seq_id, step, id, exp((x - max(x) OVER (PARTITION BY seq_id, step)) / 0.7) AS w FROM x),
c AS (SELECT *, sum(w) OVER (PARTITION BY seq_id, step ORDER BY w DESC, id ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY seq_id, step) AS total FROM w),
k AS (SELECT *, max(upto) OVER (PARTITION BY seq_id, step) AS mass, count(*) OVER (PARTITION BY seq_id, step) AS n_kept FROM c WHERE upto - w < 0.9 * total),
d AS (SELECT *, row_number() OVER (PARTITION BY seq_id, step ORDER BY upto) AS r FROM k
      WHERE upto > ('0x' || md5('music:' || seq_id || ':' || step)[:13])::BIGINT / 4503599627370496.0 * mass)
SELECT seq_id, step, id AS token, round(w / mass, 6) AS p, n_kept FROM d WHERE r = 1""",
    "sounding_part": """
WITH x AS (SELECT vec_id, len(embedding) AS n, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)),
s AS (SELECT vec_id, n, i, sum(x * x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS e FROM x),
f AS (SELECT vec_id, n, i // 2 AS f, e FROM s WHERE i % 2 = 0
      UNION ALL SELECT vec_id, n, n // 2, sum(x * x) FILTER (i >= n - 4) FROM x WHERE n % 2 = 0 GROUP BY vec_id, n),
m AS (SELECT *, max(e) OVER (PARTITION BY vec_id) AS most FROM f),
b AS (SELECT vec_id, any_value(n) AS n, min(f) FILTER (e > most * 10 ** -0.6) AS a, max(f) FILTER (e > most * 10 ** -0.6) AS z FROM m GROUP BY vec_id)
SELECT vec_id, CAST(n AS BIGINT) AS n, CAST(least(coalesce(2 * a, 0), n) AS BIGINT) AS start, CAST(least(coalesce(2 * z + 2, 0), n) AS BIGINT) AS "end" FROM b""",
    "gated_loudness": """
WITH x AS (SELECT label, CAST(embedding[i + 1] AS DOUBLE) AS x, i FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)),
p AS (SELECT label, x * x * CASE WHEN i % 100 = 99 THEN 1e-9 ELSE 1 END AS power FROM x),
g AS (SELECT label, power, -0.691 + 10 * log10(power) > -70 AS loud FROM p WHERE power > 0 UNION ALL SELECT label, power, false FROM p WHERE power <= 0),
m AS (SELECT *, avg(power) FILTER (loud) OVER (PARTITION BY label) AS mean FROM g)
SELECT label, count(*) AS n_blocks, count(*) FILTER (loud AND power > mean / 10) AS n_gated, round(-0.691 + 10 * log10(avg(power) FILTER (loud AND power > mean / 10)), 6) AS loudness
FROM m GROUP BY label""",
    "midi_read_back": f"""
WITH {_PACKED},
note AS (SELECT seq_id, (event_id * 7) % 16512 AS note, h AS a, h + greatest(1, event_id % 1000) AS z FROM e),
a AS (SELECT seq_id, note, a, row_number() OVER (PARTITION BY seq_id, note ORDER BY a) AS k FROM note),
z AS (SELECT seq_id, note, z, row_number() OVER (PARTITION BY seq_id, note ORDER BY z) AS k FROM note)
SELECT seq_id, CAST(a AS BIGINT) AS time, CAST(10000 + least(z - a, 999) AS BIGINT) AS dur, CAST(note + 11000 AS BIGINT) AS note FROM a JOIN z USING (seq_id, note, k)""",
    "output_paths": """
SELECT event_id, strftime(ts, '%Y-%m-%d_%H%M%S') || '/' || strftime(ts, '%Y%m%d_%H%M%S') || '_prompt_' || (user_id + 1) || '/gen_' || event_id || '.mid' AS path FROM events""",
    "evaluation_ids": "SELECT DISTINCT md5(text) AS id FROM documents WHERE text IS NOT NULL AND doc_id % 7 IN (0, 2, 5, 6)",
    "session_times": """
SELECT user_id, round(max(epoch_us(ts) / 1e6 + value) - min(epoch_us(ts) / 1e6), 3) AS total_time FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY user_id""",
    "validation_switch": f"""
WITH {_PACKED},
c AS (SELECT seq_id, token, count(*) AS n FROM tok WHERE pos % 3 = 0 GROUP BY ALL),
s AS (SELECT seq_id, CASE WHEN max(n) > 7 THEN 'excessive' ELSE 'pass' END AS status FROM c GROUP BY seq_id)
SELECT validated, status, count(*) FILTER (status = 'pass' OR NOT validated) AS good, count(*) FILTER (status <> 'pass' AND validated) AS rejected
FROM s, (SELECT unnest([true, false]) AS validated) GROUP BY ALL""",
}
