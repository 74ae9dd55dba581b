"""SQL (DuckDB) that must give the same rows as the query of the same name."""

from __future__ import annotations

from lumenprep.functions.messages import QUESTION_HEAD, QUESTION_TAIL
from lumenprep.operators.pixels import LUMA_TABLE, NOISE_PRIME, NOISE_STEP, NOISE_UNIT, noise_scale

ORACLES: dict[str, str] = {}


def h52(key: str, salt: str) -> str:
    """The seeded 52-bit hash of a key."""
    text = f"concat_ws(':', '42', CAST({key} AS VARCHAR), '{salt}')"
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


def u01(key: str, salt: str) -> str:
    return f"(CAST({h52(key, salt)} AS DOUBLE) / CAST(4503599627370496 AS DOUBLE))"


def pick(key: str, salt: str, n: str) -> str:
    return f"CAST(floor({u01(key, salt)} * CAST({n} AS DOUBLE)) AS BIGINT)"


def gate(key: str, salt: str, p: float) -> str:
    return f"({u01(key, salt)} < CAST({p} AS DOUBLE))"


def dbl(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


LABELLED = "labelled AS (SELECT d.*, d.lang AS dataset, l.toxic AS label, l.quality FROM documents d JOIN labels l USING (doc_id))"
PLACE = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END"
FRACTION = f"CASE dataset WHEN 'en' THEN {dbl(0.1)} WHEN 'fr' THEN {dbl(0.2)} WHEN 'de' THEN {dbl(0.05)} END"


def stratified(base: str, key: str, fraction: str) -> str:
    """CTEs that end in ``tagged``: rows of ``base`` with their split."""
    return f"""
    class_n AS (SELECT dataset, label, count(*) AS c FROM {base} GROUP BY dataset, label),
    set_n AS (SELECT *, sum(c) OVER (PARTITION BY dataset) AS n FROM class_n),
    held AS (SELECT *, coalesce(CAST(ceil(({fraction}) * CAST(n AS DOUBLE)) AS BIGINT), 0) AS k FROM set_n),
    share AS (SELECT *, CAST((k * c) // n AS BIGINT) AS base, (k * c) % n AS rest FROM held),
    quota AS (
      SELECT dataset, label, base + CASE WHEN row_number() OVER (
          PARTITION BY dataset ORDER BY rest DESC, label ASC NULLS LAST)
        <= k - sum(base) OVER (PARTITION BY dataset) THEN 1 ELSE 0 END AS q
      FROM share),
    ranked AS (
      SELECT b.*, row_number() OVER (
          PARTITION BY b.dataset, b.label ORDER BY {h52(f'b.{key}', 'split')}, b.{key}) AS rn
      FROM {base} b),
    tagged AS (
      SELECT r.*, CASE WHEN r.rn <= q.q THEN 'eval' ELSE 'train' END AS split
      FROM ranked r JOIN quota q ON r.dataset = q.dataset AND r.label IS NOT DISTINCT FROM q.label)
    """


# --- whole jobs ------------------------------------------------------------------------

JOB = f"""
WITH {LABELLED},
base AS (SELECT *, lang || '/train/' || CAST(doc_id AS VARCHAR) AS example_id, {PLACE} AS ds_pos FROM labelled),
{stratified('base', 'example_id', FRACTION)},
turn AS (SELECT *, row_number() OVER (PARTITION BY split, ds_pos ORDER BY doc_id) AS rr FROM tagged)
"""
JOB_COLUMNS = f"""example_id, dataset, label,
  '{QUESTION_HEAD}' || CASE WHEN lang = 'en' THEN 'image' ELSE 'video' END || '{QUESTION_TAIL}' AS prompt,
  CASE label WHEN 1 THEN 'Fake' WHEN 0 THEN 'Real' END AS completion"""
INTERLEAVED = "row_number() OVER (PARTITION BY split ORDER BY rr, ds_pos) - 1"

ORACLES["prepared_interleave"] = f"{JOB} SELECT split, {INTERLEAVED} AS pos, {JOB_COLUMNS} FROM turn"
ORACLES["prepared_concat"] = f"""{JOB} SELECT split,
  row_number() OVER (PARTITION BY split ORDER BY ds_pos, doc_id) - 1 AS pos, {JOB_COLUMNS} FROM turn"""
ORACLES["prepared_shuffle"] = f"""{JOB} SELECT split,
  row_number() OVER (PARTITION BY split ORDER BY {h52('example_id', 'shuffle')}, example_id) - 1 AS pos,
  {JOB_COLUMNS} FROM turn"""
# Base64 text comes in lines of 76 characters.
B64 = "(4 * ((strlen(text) + 2) // 3))"
VIDEO_CHARS = f"({B64} + 2 * (({B64} - 1) // 76))"
ORACLES["prepared_write"] = f"""{JOB} SELECT split, {INTERLEAVED} AS pos, example_id,
  CASE WHEN lang = 'en' THEN CAST(strlen(text) AS BIGINT) ELSE -1 END AS image_bytes,
  CASE WHEN lang <> 'en' THEN CAST({VIDEO_CHARS} AS BIGINT) ELSE -1 END AS video_chars FROM turn"""

ORACLES["prepared_named_eval"] = f"""
WITH {LABELLED},
sliced AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, CAST(count(*) OVER () AS DOUBLE) AS n
  FROM labelled WHERE lang = 'en' AND quality = 1),
other AS (
  SELECT 'others' AS dataset, 'others/train/' || CAST(doc_id AS VARCHAR) AS example_id, doc_id, label
  FROM labelled WHERE lang <> 'en'),
{stratified('other', 'example_id', dbl(0.1))},
allrows AS (
  SELECT 'train' AS split, 0 AS ds, 0 AS term, 'en/train/' || CAST(doc_id AS VARCHAR) || '@0' AS example_id, doc_id, label
  FROM sliced WHERE i < round_even(40 * n / 100, 0) UNION ALL
  SELECT 'train', 0, 1, 'en/train/' || CAST(doc_id AS VARCHAR) || '@1', doc_id, label
  FROM sliced WHERE i >= round_even(60 * n / 100, 0) UNION ALL
  SELECT 'eval', 0, 0, 'en/test/' || CAST(doc_id AS VARCHAR), doc_id, label
  FROM labelled WHERE lang = 'en' AND quality = 0 UNION ALL
  SELECT split, 1, 0, example_id, doc_id, label FROM tagged),
turn AS (SELECT *, row_number() OVER (PARTITION BY split, ds ORDER BY term, doc_id) AS rr FROM allrows)
SELECT split, row_number() OVER (PARTITION BY split ORDER BY rr, ds) - 1 AS pos, example_id,
  CASE ds WHEN 0 THEN 'en' ELSE 'others' END AS dataset, label, ds = 0 AS degrade_fake FROM turn"""

# --- sources and schema ----------------------------------------------------------------

ORACLES["percent_slice"] = """
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
bounds AS (
  SELECT 0 AS t, 0 AS lo, round_even(2 * n / 100, 0) AS hi FROM n UNION ALL
  SELECT 1, n - round_even(2 * n / 100, 0), n FROM n UNION ALL
  SELECT 2, round_even(35 * n / 100, 0), round_even(65 * n / 100, 0) FROM n)
SELECT doc_id, CAST(t AS INTEGER) AS slice_term, source, CAST(length(text) AS BIGINT) AS n
FROM ranked JOIN bounds ON i >= lo AND i < hi"""
ORACLES["row_slice"] = """
SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, count(*) OVER () AS n FROM conversations)
WHERE i >= 10 AND i < n - 10"""
ORACLES["mix_signature"] = f"""
WITH {LABELLED}
SELECT CAST(doc_id AS VARCHAR) AS example_id,
  CASE lang WHEN 'en' THEN 'image' WHEN 'fr' THEN 'video' ELSE 'prompt' END AS dataset,
  CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS INTEGER) AS ds_pos,
  label, lang = 'en' AS degrade_fake,
  CAST(CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS INTEGER) AS n_images,
  CASE WHEN lang = 'en' THEN CAST(strlen(text) AS BIGINT) ELSE -1 END AS image_bytes,
  CASE WHEN lang = 'fr' THEN CAST(length(text) AS BIGINT) ELSE -1 END AS video_chars,
  CASE WHEN lang NOT IN ('en', 'fr') THEN text END AS prompt,
  TRUE AS no_completion
FROM labelled"""
ORACLES["label_cast"] = """
SELECT doc_id, toxic AS from_index, quality AS from_name, toxic AS from_text,
  CAST(CASE WHEN toxic = 1 THEN -1 ELSE toxic END AS BIGINT) AS with_null FROM labels"""
ORACLES["video_decode"] = """
SELECT doc_id, CASE WHEN lang <> 'de' THEN CAST(strlen(text) AS BIGINT) ELSE -1 END AS n_bytes,
  CASE WHEN lang <> 'de' THEN md5(text) END AS digest, lang = 'de' AS bad FROM documents"""

# --- messages --------------------------------------------------------------------------

ORACLES["modality_prompt"] = f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN 'image' ELSE 'video' END AS modality, 'user' AS role,
  '{QUESTION_HEAD}' || CASE WHEN lang = 'en' THEN 'image' ELSE 'video' END || '{QUESTION_TAIL}' AS prompt
FROM documents"""
ORACLES["completion_from_label"] = """
SELECT doc_id, CASE toxic WHEN 1 THEN 'Fake' ELSE 'Real' END AS completion,
  CASE toxic WHEN 1 THEN 'Real' ELSE 'Fake' END AS inverted,
  CASE WHEN quality = 0 THEN 'Unsure' WHEN toxic = 1 THEN 'Fake' ELSE 'Real' END AS kept
FROM labels"""
PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, a.role, a.text, b.role AS next_role, b.text AS next_text
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
EXCHANGES = f"{PAIRS}, exchange AS (SELECT * FROM pairs WHERE role = 'user' AND next_role = 'assistant')"
ORACLES["normalise_messages"] = f"""
WITH {PAIRS},
msg AS (
  SELECT conv_id, turn, 0 AS message, role, text, role = 'user' AS first_user FROM pairs UNION ALL
  SELECT conv_id, turn, 1, next_role, next_text, next_role = 'user' AND role <> 'user' FROM pairs),
media AS (
  SELECT m.*, CASE WHEN first_user THEN conv_id % 3 ELSE 0 END AS n_images,
    CASE WHEN first_user AND conv_id % 4 = 0 THEN 1 ELSE 0 END AS n_video FROM msg m),
parts AS (
  SELECT conv_id, turn, message, role, i AS part, 'image' AS type, NULL AS text, i AS media_idx
  FROM media, range(0, 3) r(i) WHERE i < n_images UNION ALL
  SELECT conv_id, turn, message, role, n_images, 'video', NULL, 0 FROM media WHERE n_video = 1 UNION ALL
  SELECT conv_id, turn, message, role, n_images + n_video, 'text', text, NULL FROM media)
SELECT conv_id, turn, CAST(message AS INTEGER) AS message, role, CAST(part AS INTEGER) AS part, type, text,
  CAST(coalesce(media_idx, -1) AS BIGINT) AS media_idx FROM parts"""


def chatml(role: str, text: str) -> str:
    return f"'<|im_start|>' || {role} || '\n' || {text} || '<|im_end|>\n'"


ANSWER_HEADER = "'<|im_start|>assistant\n'"
ORACLES["chat_render"] = f"""
WITH {EXCHANGES}
SELECT conv_id, turn, {chatml('role', 'text')} || {ANSWER_HEADER} AS prompt_text,
  {chatml('role', 'text')} || {chatml('next_role', 'next_text')} AS full_text FROM exchange"""
IMAGE_MARK = "<|vision_start|><|image_pad|><|vision_end|>"
VIDEO_MARK = "<|vision_start|><|video_pad|><|vision_end|>"
MARKED = f"CASE WHEN role = 'user' THEN '{IMAGE_MARK}{IMAGE_MARK}{VIDEO_MARK}' ELSE '' END || text"
ORACLES["chat_render_media"] = (
    f"SELECT conv_id, turn, {chatml('role', f'({MARKED})')} AS rendered FROM conversations"
)
ORACLES["completion_suffix"] = f"""
WITH {EXCHANGES} SELECT conv_id, turn, next_text || '<|im_end|>\n' AS completion_text FROM exchange"""

DIALOGUES = """last AS (
  SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AND role = 'assistant' AS answer,
    turn = min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS first_user FROM conversations)"""
ORACLES["chat_render_conversations"] = f"""
WITH {DIALOGUES}
SELECT conv_id, coalesce(string_agg({chatml('role', 'text')}, '' ORDER BY turn) FILTER (NOT answer), '') || {ANSWER_HEADER} AS prompt_text,
  string_agg({chatml('role', 'text')}, '' ORDER BY turn) AS full_text FROM last GROUP BY conv_id"""

# --- sizes -----------------------------------------------------------------------------

SIZES = """sizes AS (
  SELECT l_orderkey, l_linenumber, l_quantity,
    CAST((l_orderkey * 7919 + l_linenumber * 104729) % 4981 + 20 AS INTEGER) AS h,
    CAST((l_orderkey * 15485863 + l_linenumber * 1299709) % 4981 + 20 AS INTEGER) AS w FROM lineitem)"""
ORACLES["resize_plan"] = f"""
WITH {SIZES},
d AS (SELECT *, CAST(h AS DOUBLE) AS a, CAST(w AS DOUBLE) AS b FROM sizes),
r AS (SELECT *, greatest(round_even(a / 32, 0) * 32, 32) AS rh, greatest(round_even(b / 32, 0) * 32, 32) AS rw,
  sqrt(a * b / CAST(1310720 AS DOUBLE)) AS shrink, sqrt(CAST(262144 AS DOUBLE) / (a * b)) AS grow FROM d)
SELECT l_orderkey, l_linenumber, h, w,
  CAST(CASE WHEN rh * rw > 1310720 THEN greatest(floor(a / shrink / 32) * 32, 32)
            WHEN rh * rw < 262144 THEN ceil(a * grow / 32) * 32 ELSE rh END AS INTEGER) AS new_h,
  CAST(CASE WHEN rh * rw > 1310720 THEN greatest(floor(b / shrink / 32) * 32, 32)
            WHEN rh * rw < 262144 THEN ceil(b * grow / 32) * 32 ELSE rw END AS INTEGER) AS new_w
FROM r"""
ORACLES["area_matched_size"] = f"""
WITH {SIZES},
s AS (SELECT *, sqrt(CAST(l_quantity * 10 AS DOUBLE) * CAST(480 AS DOUBLE) / (CAST(h AS DOUBLE) * w)) AS scale FROM sizes)
SELECT l_orderkey, l_linenumber, CAST(greatest(1, floor(h * scale)) AS INTEGER) AS new_h,
  CAST(greatest(1, floor(w * scale)) AS INTEGER) AS new_w FROM s"""
ORACLES["frame_indices"] = """
SELECT doc_id, n_chars AS n_all, n_chars - 1 AS last,
  array_to_string([CAST(floor((i * n_chars) / least(n_chars, 30)) AS BIGINT)
    FOR i IN range(0, least(n_chars, 30))], ',') AS spread
FROM documents"""
ORACLES["run_sizing"] = f"""
WITH {LABELLED}, n AS (SELECT count(*) AS n FROM labelled)
SELECT p_partkey, CAST((700000 // (p_size * 2)) // (p_partkey % 4 + 1) * 3 AS BIGINT) AS n_steps,
  n AS labelled_rows, CAST((n // 4) * 3 AS BIGINT) AS labelled_steps FROM part, n"""

# --- images ----------------------------------------------------------------------------

PIX = f"""pix AS (
  SELECT vec_id, label % 2 AS label, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
    CAST(floor(greatest(least((CAST(embedding[i] AS DOUBLE) + 1) / 2, {dbl(1)}), {dbl(0)}) * 255) AS BIGINT) AS v
  FROM embeddings, range(1, 65) r(i))"""


def neighbours(source: str, key: str = "vec_id") -> str:
    """Pixels with their four neighbours, mirrored at the edges."""
    down, across = f"(PARTITION BY {key}, x ORDER BY y)", f"(PARTITION BY {key}, y ORDER BY x)"
    return f"""SELECT *, coalesce(lag(v) OVER {down}, lead(v) OVER {down}, v) AS up,
      coalesce(lead(v) OVER {down}, lag(v) OVER {down}, v) AS down,
      coalesce(lag(v) OVER {across}, lead(v) OVER {across}, v) AS lft,
      coalesce(lead(v) OVER {across}, lag(v) OVER {across}, v) AS rgt FROM {source}"""


def blur_of(source: str, key: str = "vec_id") -> str:
    """Variance of the Laplacian from whole-number sums."""
    return f"""SELECT {key}, CAST(count(*) * sum(l * l) - sum(l) * sum(l) AS DOUBLE)
        / (CAST(count(*) AS DOUBLE) * count(*)) AS blur
      FROM (SELECT {key}, up + down + lft + rgt - 4 * v AS l FROM ({neighbours(source, key)})) GROUP BY {key}"""


ORACLES["blur_estimate"] = f"""
WITH {PIX}, b AS ({blur_of('pix')}) SELECT vec_id, round(blur, 6) AS blur FROM b"""
ORACLES["blur_of_texts"] = f"""
WITH bytes AS (
  SELECT doc_id, regexp_extract_all(rpad(hex(encode(text)), CAST(ceil(strlen(text) / 48) * 96 AS INTEGER), '0'), '.{{6}}') AS p
  FROM documents),
cells AS (SELECT doc_id, unnest(p) AS c, unnest(range(0, len(p))) AS i FROM bytes),
pix AS (
  SELECT doc_id, i // 16 AS y, i % 16 AS x,
    (3735 * CAST('0x' || substr(c, 1, 2) AS BIGINT) + 19235 * CAST('0x' || substr(c, 3, 2) AS BIGINT)
      + 9798 * CAST('0x' || substr(c, 5, 2) AS BIGINT) + 16384) >> 15 AS v FROM cells),
b AS ({blur_of('pix', 'doc_id')})
SELECT doc_id, round(blur + 1e-7, 4) AS blur FROM documents LEFT JOIN b USING (doc_id)"""
PROFILE = f"""blurs AS ({blur_of('pix')}),
profile AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, blur, CAST(8 AS INTEGER) AS height, CAST(8 AS INTEGER) AS width
  FROM blurs JOIN (SELECT vec_id FROM embeddings WHERE label % 2 = 0) USING (vec_id))"""
ORACLES["real_profile"] = f"""
WITH {PIX}, {PROFILE} SELECT idx, round(blur, 6) AS blur, height, width FROM profile"""
ORACLES["profile_sample"] = f"""
WITH {PIX}, {PROFILE},
hashed AS (SELECT {h52("CAST(vec_id AS VARCHAR) || '#0'", 'profile')} AS hash, blur FROM blurs JOIN embeddings USING (vec_id) WHERE label % 2 = 0)
SELECT row_number() OVER (ORDER BY hash) - 1 AS idx, round(blur, 6) AS blur, CAST(8 AS INTEGER) AS height, CAST(8 AS INTEGER) AS width, hash
FROM hashed ORDER BY hash LIMIT 100"""
ORACLES["checked_messages"] = """
SELECT role = 'system' AS bad, role, count(*) AS n_turns, (SELECT count(*) FROM conversations) AS n_rows,
  (SELECT count(*) FROM conversations WHERE role = 'system') AS n_bad,
  (SELECT count(*) FROM conversations WHERE role = 'assistant') AS n_answers,
  (SELECT count(*) FROM conversations WHERE text = '') AS n_empty
FROM conversations GROUP BY role"""
ORACLES["profile_summary"] = f"""
WITH {PIX}, {PROFILE}
SELECT count(*) AS n_images, round(min(blur), 6) AS min_blur, round(max(blur), 6) AS max_blur,
  round(avg(blur), 4) AS avg_blur, avg(CAST(height AS DOUBLE) * width) AS avg_area,
  {', '.join(f"round(quantile_disc(blur, {q}), 6) AS blur_q{i}, quantile_disc(CAST(height AS DOUBLE) * width, {q}) AS area_q{i}" for i, q in enumerate((0.05, 0.25, 0.5, 0.75, 0.95)))}
FROM profile"""


def hex_of(channels: int = 1) -> str:
    return f"string_agg(repeat(printf('%02X', v), {channels}), '' ORDER BY y, x) AS pixels"


def blurred(source: str, columns: str) -> str:
    """Three-tap Gaussian with weights 1, 254, 1 of 256: across, then down."""
    across = f"SELECT {columns}, y, x, lft + 254 * v + rgt AS v FROM ({neighbours(source)})"
    return f"SELECT {columns}, y, x, (up + 254 * v + down + 32768) >> 16 AS v FROM ({neighbours(f'({across})')})"


ORACLES["gaussian_blur"] = f"""
WITH {PIX}, done AS ({blurred('pix', 'vec_id')}) SELECT vec_id, {hex_of()} FROM done GROUP BY vec_id"""
ORACLES["resize_pixels"] = f"""
WITH {PIX},
outs AS (SELECT n, o, {dbl(8)} / n AS ratio, greatest({dbl(8)} / n, 1) AS reach, (o + {dbl(0.5)}) * ({dbl(8)} / n) AS centre
  FROM range(1, 14) a(n), range(0, 14) b(o) WHERE o < n),
taps AS (
  SELECT n, o, p, greatest(1 - abs((p - centre + {dbl(0.5)}) / reach), {dbl(0)}) AS wt FROM outs, range(0, 8) c(p)
  WHERE p >= greatest(trunc(centre - reach + {dbl(0.5)}), 0) AND p < least(trunc(centre + reach + {dbl(0.5)}), 8)),
fixed AS (SELECT n, o, p, CAST(floor(wt / sum(wt) OVER (PARTITION BY n, o) * 4194304 + {dbl(0.5)}) AS BIGINT) AS k FROM taps),
across AS (
  SELECT vec_id, y, o AS x, greatest(0, least(255, (CAST(sum(v * k) AS BIGINT) + 2097152) >> 22)) AS v
  FROM pix JOIN fixed ON n = vec_id % 11 + 3 AND p = x GROUP BY vec_id, y, o),
done AS (
  SELECT vec_id, o AS y, x, greatest(0, least(255, (CAST(sum(v * k) AS BIGINT) + 2097152) >> 22)) AS v
  FROM across JOIN fixed ON n = vec_id % 13 + 1 AND p = y GROUP BY vec_id, o, x)
SELECT vec_id, CAST(vec_id % 13 + 1 AS INTEGER) AS height, CAST(vec_id % 11 + 3 AS INTEGER) AS width, {hex_of()}
FROM done GROUP BY vec_id"""


def jpeg(source: str, name: str) -> str:
    """CTEs that end in ``name``: 8x8 gray pixels (with their quality) after quantisation."""
    table = "[" + ", ".join(LUMA_TABLE.split()) + "]"
    return f"""
    cosine AS (
      SELECT k, i, cos((2 * i + 1) * k * pi() / 16) / 2 * CASE WHEN k = 0 THEN 1 / sqrt({dbl(2)}) ELSE 1 END AS c
      FROM range(0, 8) a(k), range(0, 8) b(i)),
    f1 AS (SELECT vec_id, quality, k AS u, x, sum(c * (v - 128)) AS s FROM {source} JOIN cosine ON i = y GROUP BY ALL),
    f2 AS (SELECT vec_id, quality, u, k AS w, sum(c * s) AS s FROM f1 JOIN cosine ON i = x GROUP BY ALL),
    steps AS (
      SELECT *, CAST(greatest(1, least(255, ({table}[u * 8 + w + 1] * (200 - 2 * quality) + 50) // 100)) AS DOUBLE) AS t FROM f2),
    kept AS (SELECT *, sign(s) * floor(abs(s / t) + {dbl(0.5)} + 1e-9) * t AS q FROM steps),
    b1 AS (SELECT vec_id, i AS y, w, sum(c * q) AS s FROM kept JOIN cosine ON k = u GROUP BY ALL),
    b2 AS (SELECT vec_id, y, i AS x, sum(c * s) AS s FROM b1 JOIN cosine ON k = w GROUP BY ALL),
    {name} AS (
      SELECT vec_id, y, x, CAST(greatest(0, least(255, floor(s + 128 + {dbl(0.5)} + 1e-9))) AS BIGINT) AS v FROM b2)"""


QUALITY = f"CAST({pick('vec_id', 'quality', '25')} + 70 AS INTEGER)"
ORACLES["jpeg_recompress"] = f"""
WITH {PIX}, rated AS (SELECT *, {QUALITY} AS quality FROM pix), {jpeg('rated', 'done')}
SELECT vec_id, {QUALITY} AS quality, CAST(3 AS INTEGER) AS channels, {hex_of(3)} FROM done GROUP BY vec_id"""
N_PROFILE = "(SELECT count(*) FROM profile)"


def choices(key: str) -> str:
    return f"""{gate(key, 'resize', 0.2)} AS resize, {gate(key, 'blur', 0.2)} AS blur,
      {gate(key, 'noise', 0.2)} AS noise, {gate(key, 'jpeg', 0.2)} AS jpeg,
      CAST({pick(key, 'quality', '25')} + 70 AS INTEGER) AS quality, {h52(key, 'noise_seed')} AS noise_seed,
      {pick(key, 'resolution', N_PROFILE)} AS res_idx, {pick(key, 'target_blur', N_PROFILE)} AS blur_idx"""


ORACLES["degrade_plan"] = f"""
WITH {PIX}, {PROFILE},
plan AS (
  SELECT doc_id, CAST(i AS INTEGER) AS image_pos, {choices("CAST(doc_id AS VARCHAR) || '#' || CAST(i AS VARCHAR)")}
  FROM labels, range(0, 2) r(i))
SELECT p.doc_id, image_pos, resize, p.blur, noise, jpeg, quality, noise_seed,
  s.height AS target_h, s.width AS target_w, round(b.blur, 6) AS target_blur
FROM plan p JOIN profile s ON s.idx = res_idx JOIN profile b ON b.idx = blur_idx"""
ORACLES["degrade_apply"] = f"""
WITH {PIX}, {PROFILE},
plan AS (
  SELECT vec_id, label % 2 AS label, label % 2 = 1 AND vec_id % 5 > 0 AS needed,
    {choices("CAST(vec_id AS VARCHAR) || '#0'")} FROM embeddings),
choice AS (
  SELECT p.vec_id, p.label, needed AND p.jpeg AS jpeg, p.quality,
    needed AND p.blur AND b.blur > {dbl(1.2)} * t.blur AS soften
  FROM plan p JOIN blurs b ON b.vec_id = p.vec_id JOIN profile t ON t.idx = p.blur_idx),
soft AS ({blurred('pix', 'vec_id')}),
stage1 AS (
  SELECT c.vec_id, c.quality, c.jpeg, p.y, p.x, CASE WHEN c.soften THEN s.v ELSE p.v END AS v
  FROM pix p JOIN choice c ON c.vec_id = p.vec_id JOIN soft s ON s.vec_id = p.vec_id AND s.y = p.y AND s.x = p.x),
{jpeg('(SELECT * FROM stage1 WHERE jpeg)', 'packed')},
done AS (
  SELECT vec_id, y, x, v, 1 AS channels FROM stage1 WHERE NOT jpeg UNION ALL
  SELECT vec_id, y, x, v, 3 FROM packed)
SELECT d.vec_id, CAST(c.label AS INTEGER) AS label, CAST(1 AS INTEGER) AS n_images, CAST(channels AS INTEGER) AS channels,
  string_agg(repeat(printf('%02X', v), channels), '' ORDER BY y, x) AS pixels
FROM done d JOIN choice c ON c.vec_id = d.vec_id GROUP BY d.vec_id, c.label, channels"""

NOISE = f"""CAST((({{sum}} - {2 * NOISE_PRIME}) * {noise_scale(5)} + CAST({NOISE_PRIME} AS BIGINT) * {NOISE_UNIT // 2}
  + CAST({NOISE_PRIME} AS BIGINT) * {64 * NOISE_UNIT}) // (CAST({NOISE_PRIME} AS BIGINT) * {NOISE_UNIT}) - 64 AS BIGINT)"""
ORACLES["degrade_noise"] = f"""
WITH {PIX}, {PROFILE},
twice AS (SELECT row_number() OVER (ORDER BY idx, i) - 1 AS idx, blur FROM profile, range(0, 2) r(i)),
plan AS (
  SELECT 2 * vec_id + i AS id, vec_id, i AS image_pos, label % 2 AS label, label % 2 = 1 AS needed,
    {choices("CAST(vec_id AS VARCHAR) || '#' || CAST(i AS VARCHAR)").replace(N_PROFILE, '(SELECT count(*) FROM twice)')}
  FROM embeddings, range(0, 2) r(i)),
choice AS (
  SELECT p.*, needed AND p.jpeg AS pack, needed AND p.noise AS grain, needed AND p.blur AND b.blur > {dbl(1.2)} * t.blur AS soften
  FROM plan p JOIN blurs b ON b.vec_id = p.vec_id JOIN twice t ON t.idx = p.blur_idx),
soft AS ({blurred('pix', 'vec_id')}),
softened AS (
  SELECT c.id, c.quality, c.pack, c.grain, c.noise_seed, p.y, p.x, CASE WHEN c.soften THEN s.v ELSE p.v END AS v
  FROM pix p JOIN choice c ON c.vec_id = p.vec_id JOIN soft s ON s.vec_id = p.vec_id AND s.y = p.y AND s.x = p.x),
n0 AS (SELECT *, (noise_seed % {NOISE_PRIME} + (8 * y + x) * CAST({NOISE_STEP} AS BIGINT)) % {NOISE_PRIME} AS u FROM softened),
n1 AS (SELECT *, u * u % {NOISE_PRIME} AS u1 FROM n0),
n2 AS (SELECT *, (u1 + 1) * (u1 + 1) % {NOISE_PRIME} AS u2 FROM n1),
n3 AS (SELECT *, (u2 + 2) * (u2 + 2) % {NOISE_PRIME} AS u3 FROM n2),
n4 AS (SELECT *, (u3 + 3) * (u3 + 3) % {NOISE_PRIME} AS u4 FROM n3),
stage1 AS (
  SELECT id AS vec_id, quality, pack AS jpeg, y, x,
    CASE WHEN grain THEN least(255, greatest(0, v + {NOISE.format(sum='(u1 + u2 + u3 + u4)')})) ELSE v END AS v FROM n4),
{jpeg('(SELECT * FROM stage1 WHERE jpeg)', 'packed')},
done AS (
  SELECT vec_id, y, x, v, 1 AS channels FROM stage1 WHERE NOT jpeg UNION ALL
  SELECT vec_id, y, x, v, 3 FROM packed)
SELECT c.vec_id, CAST(c.label AS INTEGER) AS label, CAST(c.image_pos AS INTEGER) AS image_pos, CAST(channels AS INTEGER) AS channels,
  string_agg(repeat(printf('%02X', v), channels), '' ORDER BY y, x) AS pixels
FROM done d JOIN choice c ON c.id = d.vec_id GROUP BY c.vec_id, c.label, c.image_pos, channels"""

# The taps of the triangle filter from 8 pixels to n, and resizing 8x8 gray pixels with them.
TAPS = f"""outs AS (SELECT n, o, {dbl(8)} / n AS ratio, greatest({dbl(8)} / n, 1) AS reach, (o + {dbl(0.5)}) * ({dbl(8)} / n) AS centre
  FROM range(1, 14) a(n), range(0, 14) b(o) WHERE o < n),
taps AS (
  SELECT n, o, p, greatest(1 - abs((p - centre + {dbl(0.5)}) / reach), {dbl(0)}) AS wt FROM outs, range(0, 8) c(p)
  WHERE p >= greatest(trunc(centre - reach + {dbl(0.5)}), 0) AND p < least(trunc(centre + reach + {dbl(0.5)}), 8)),
fixed AS (SELECT n, o, p, CAST(floor(wt / sum(wt) OVER (PARTITION BY n, o) * 4194304 + {dbl(0.5)}) AS BIGINT) AS k FROM taps)"""


def resized(source: str, name: str) -> str:
    """CTEs that end in ``name``: pixels of ``source`` (vec_id, y, x, v, h, w) in the size h times w."""
    return f"""{name}_across AS (
  SELECT vec_id, h, w, y, o AS x, greatest(0, least(255, (CAST(sum(v * k) AS BIGINT) + 2097152) >> 22)) AS v
  FROM {source} JOIN fixed ON n = w AND p = x GROUP BY vec_id, h, w, y, o),
{name} AS (
  SELECT vec_id, h, w, o AS y, x, greatest(0, least(255, (CAST(sum(v * k) AS BIGINT) + 2097152) >> 22)) AS v
  FROM {name}_across JOIN fixed ON n = h AND p = y GROUP BY vec_id, h, w, o, x)"""


ORACLES["prepared_degraded"] = f"""
WITH {PIX}, {TAPS},
sized AS (SELECT vec_id, y, x, v, vec_id % 13 + 1 AS h, vec_id % 11 + 3 AS w FROM pix WHERE label = 0),
{resized('sized', 'seen')},
seen_blur AS ({blur_of('seen')}),
profile AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, blur, vec_id % 13 + 1 AS height, vec_id % 11 + 3 AS width FROM seen_blur),
base AS (
  SELECT CASE WHEN label % 2 = 0 THEN 'real' WHEN vec_id % 5 > 0 THEN 'fake' ELSE 'kept' END AS dataset, vec_id,
    CAST(label % 2 AS INTEGER) AS label FROM embeddings),
named AS (SELECT *, dataset || '/train/' || CAST(vec_id AS VARCHAR) AS example_id,
  CASE dataset WHEN 'real' THEN 0 WHEN 'fake' THEN 1 ELSE 2 END AS ds_pos FROM base),
{stratified('named', 'example_id', f"CASE dataset WHEN 'real' THEN {dbl(0.1)} WHEN 'fake' THEN {dbl(0.1)} END")},
turn AS (SELECT *, row_number() OVER (PARTITION BY split, ds_pos ORDER BY vec_id) AS rr FROM tagged),
placed AS (SELECT *, {INTERLEAVED} AS pos FROM turn),
plan AS (
  SELECT vec_id, {choices("example_id || '#0'").replace(dbl(0.2), dbl(0.5))} FROM placed WHERE dataset = 'fake' AND split = 'train'),
target AS (
  SELECT p.*, t.blur AS target_blur,
    CASE WHEN p.resize THEN CAST(greatest(1, trunc(8 * sqrt(CAST(s.height * s.width AS DOUBLE) / 64))) AS BIGINT) ELSE 8 END AS side
  FROM plan p JOIN profile s ON s.idx = p.res_idx JOIN profile t ON t.idx = p.blur_idx),
wanted AS (SELECT p.vec_id, y, x, v, side AS h, side AS w FROM pix p JOIN target USING (vec_id)),
{resized('wanted', 'moved')},
moved_blur AS ({blur_of('moved')}),
soft AS ({blurred('moved', 'vec_id')}),
softened AS (
  SELECT m.vec_id, m.y, m.x, m.w, CASE WHEN t.blur AND b.blur > {dbl(1.2)} * t.target_blur THEN s.v ELSE m.v END AS v,
    t.noise, t.jpeg, t.quality, t.noise_seed
  FROM moved m JOIN target t USING (vec_id) JOIN moved_blur b USING (vec_id) JOIN soft s ON s.vec_id = m.vec_id AND s.y = m.y AND s.x = m.x),
n0 AS (SELECT *, (noise_seed % {NOISE_PRIME} + (w * y + x) * CAST({NOISE_STEP} AS BIGINT)) % {NOISE_PRIME} AS u FROM softened),
n1 AS (SELECT *, u * u % {NOISE_PRIME} AS u1 FROM n0),
n2 AS (SELECT *, (u1 + 1) * (u1 + 1) % {NOISE_PRIME} AS u2 FROM n1),
n3 AS (SELECT *, (u2 + 2) * (u2 + 2) % {NOISE_PRIME} AS u3 FROM n2),
n4 AS (SELECT *, (u3 + 3) * (u3 + 3) % {NOISE_PRIME} AS u4 FROM n3),
noisy AS (
  SELECT *, CASE WHEN noise THEN least(255, greatest(0, v + {NOISE.format(sum='(u1 + u2 + u3 + u4)')})) ELSE v END AS grain FROM n4),
done AS (
  SELECT vec_id, y, x, CASE WHEN jpeg THEN grain // (101 - quality) * (101 - quality) ELSE grain END AS v,
    CASE WHEN jpeg THEN 3 ELSE 1 END AS channels FROM noisy
  UNION ALL SELECT vec_id, y, x, v, 1 FROM seen
  UNION ALL SELECT vec_id, y, x, v, 1 FROM pix WHERE label = 1 AND vec_id NOT IN (SELECT vec_id FROM plan))
SELECT any_value(p.split) AS split, any_value(p.pos) AS pos, p.example_id, any_value(p.label) AS label,
  CAST(max(y) + 1 AS INTEGER) AS height, CAST(max(x) + 1 AS INTEGER) AS width, CAST(any_value(channels) AS INTEGER) AS channels,
  string_agg(repeat(printf('%02X', v), channels), '' ORDER BY y, x) AS pixels
FROM done JOIN placed p USING (vec_id) GROUP BY p.example_id"""

# --- splits and order ------------------------------------------------------------------

ORACLES["seeded_draws"] = f"""
SELECT doc_id, {u01('doc_id', 'draw')} AS u, {gate('doc_id', 'gate', 0.2)} AS gate, {pick('doc_id', 'pick', '7')} AS pick
FROM labels"""
ORACLES["stratified_split"] = f"""
WITH {LABELLED}, base AS (SELECT doc_id, dataset, label FROM labelled), {stratified('base', 'doc_id', FRACTION)}
SELECT doc_id, dataset, label, split FROM tagged"""
ORACLES["stratified_split_sources"] = f"""
WITH {LABELLED}, base AS (SELECT doc_id, source AS dataset, label FROM labelled),
{stratified('base', 'doc_id', dbl(0.1))} SELECT doc_id, dataset, label, split FROM tagged"""
ORACLES["random_split"] = f"""
SELECT doc_id, lang, CASE WHEN row_number() OVER (ORDER BY {h52('doc_id', 'split')}, doc_id)
  <= ceil({dbl(0.05)} * CAST(count(*) OVER () AS DOUBLE)) THEN 'eval' ELSE 'train' END AS split FROM documents"""
ORACLES["random_split_by_set"] = f"""
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {h52('doc_id', 'split')}, doc_id)
  <= ceil({dbl(0.01)} * CAST(count(*) OVER (PARTITION BY lang) AS DOUBLE)) THEN 'eval' ELSE 'train' END AS split
FROM documents"""
ORACLES["hash_split"] = f"""
SELECT doc_id, CASE WHEN {gate('doc_id', 'split', 0.05)} THEN 'eval' ELSE 'train' END AS split FROM documents"""
SETS = f"sets AS (SELECT *, CAST({PLACE} AS INTEGER) AS ds_pos FROM documents), turns AS (SELECT *, row_number() OVER (PARTITION BY ds_pos ORDER BY doc_id) AS rr FROM sets)"
ORACLES["concat_sets"] = f"""
WITH {SETS} SELECT doc_id, lang, source, ds_pos, row_number() OVER (ORDER BY ds_pos, doc_id) - 1 AS pos FROM turns"""
ORACLES["interleave_sets"] = f"""
WITH {SETS} SELECT doc_id, lang, source, ds_pos, row_number() OVER (ORDER BY rr, ds_pos) - 1 AS pos FROM turns"""
ORACLES["interleave_wide"] = f"""
WITH {SETS} SELECT row_number() OVER (ORDER BY rr, ds_pos) - 1 AS pos, doc_id, md5(text) AS digest FROM turns"""
ORACLES["interleave_overlap"] = """
WITH rows AS (
  SELECT CAST(0 AS INTEGER) AS ds_pos, o_orderkey AS key, o_orderstatus AS kind FROM orders
  UNION ALL SELECT 1, c_custkey, c_mktsegment FROM customer),
turns AS (SELECT *, row_number() OVER (PARTITION BY ds_pos ORDER BY key) AS rr FROM rows)
SELECT ds_pos, key, kind, row_number() OVER (ORDER BY rr, ds_pos) - 1 AS pos FROM turns"""
ORACLES["prepared_overlap"] = f"""
WITH {LABELLED},
numbered AS (SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labelled),
cut AS (SELECT *, CAST(round_even(10 * n / 100.0, 0) AS BIGINT) AS k FROM numbered),
held AS (
  SELECT doc_id, label, 0 AS term FROM cut WHERE i < k UNION ALL SELECT doc_id, label, 1 FROM cut WHERE i >= n - k)
SELECT 'train' AS split, i AS pos, 'docs/train/' || doc_id AS example_id, CAST(label AS INTEGER) AS label FROM cut
UNION ALL
SELECT 'eval', row_number() OVER (ORDER BY term, doc_id) - 1, 'docs/train/' || doc_id || '@' || term, label FROM held"""
FILED = f"""filed AS (
  SELECT doc_id, text, lang, CAST({PLACE} AS INTEGER) AS ds_pos, doc_id % 10 > 0 AS training, CAST(doc_id % 2 AS INTEGER) AS label FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY ds_pos, training ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY ds_pos, training) AS n FROM filed)"""
ORACLES["prepared_files"] = f"""
WITH {FILED},
bounds AS (SELECT *, CAST(round_even(80 * n / CAST(100 AS DOUBLE), 0) AS BIGINT) AS b80, CAST(round_even(10 * n / CAST(100 AS DOUBLE), 0) AS BIGINT) AS b10 FROM numbered),
chosen AS (
  SELECT *, 'train' AS split, 0 AS term FROM bounds WHERE training AND (ds_pos IN (1, 2) OR (ds_pos = 0 AND i < b80) OR (ds_pos = 3 AND i >= 5))
  UNION ALL SELECT *, 'train', 1 FROM bounds WHERE training AND ds_pos = 0 AND i >= n - b10
  UNION ALL SELECT *, 'eval', 0 FROM bounds WHERE (NOT training AND (ds_pos = 0 OR (ds_pos = 1 AND i < 50))) OR (training AND ds_pos = 3 AND i < 5)),
turn AS (SELECT *, row_number() OVER (PARTITION BY split, ds_pos ORDER BY term, doc_id) AS rr FROM chosen)
SELECT split, {INTERLEAVED} AS pos, ['en', 'fr', 'de', 'es'][ds_pos + 1] AS dataset, label, md5(text) AS digest,
  CASE label WHEN 1 THEN 'Fake' ELSE 'Real' END AS completion FROM turn"""
ORACLES["concat_files"] = f"""
WITH {FILED} SELECT row_number() OVER (ORDER BY ds_pos, doc_id) - 1 AS pos, ds_pos, doc_id, md5(text) AS digest FROM numbered WHERE training"""
ORACLES["interleave_files"] = f"""
WITH {FILED} SELECT row_number() OVER (ORDER BY i, ds_pos) - 1 AS pos, ds_pos, doc_id, md5(text) AS digest FROM numbered WHERE training"""
SHUFFLED = f"row_number() OVER (ORDER BY {h52('doc_id', 'shuffle')}, doc_id) - 1"
ORACLES["seeded_shuffle"] = f"SELECT doc_id, lang, {SHUFFLED} AS pos FROM documents"
ORACLES["sample_budget"] = f"""
SELECT doc_id, pos FROM (SELECT doc_id, {SHUFFLED} AS pos FROM documents)
WHERE pos < (SELECT count(*) // 3 - 1 FROM documents)"""
ORACLES["row_index"] = """
SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM conversations"""
ORACLES["rank_within_sets"] = """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events"""
ORACLES["batch_ids"] = """
SELECT conv_id, turn, pos, pos // 8 AS batch_id, CAST((pos // 8) % 2 AS INTEGER) AS device_whole,
  CAST((pos % 8) // 4 AS INTEGER) AS device
FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM conversations)"""

# --- token batches ---------------------------------------------------------------------

WORDS = r"regexp_extract_all({}, '[^ \t\r\n]+')"
WORD_ID = "CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) + 3"
TOKENS = f"""{EXCHANGES},
tokens AS (
  SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 8 AS batch_id,
    [{WORD_ID} FOR w IN {WORDS.format('text')}] AS p, [{WORD_ID} FOR w IN {WORDS.format('next_text')}] AS c
  FROM exchange)"""


def many(value: str, n: str) -> str:
    return f"[{value} FOR z IN range(0, {n})]"


def collated(
    max_length: int | None, multiple: int | None, completion_only: bool, types: bool = False, tokens: str | None = None, keys: str = "conv_id, turn"
) -> str:
    whole = "list_concat(p, c)"
    cut = whole if max_length is None else f"list_slice({whole}, 1, {max_length})"
    skip = "least(len(p), len(ids))" if completion_only else "CAST(0 AS BIGINT)"
    longest = "max(n) OVER (PARTITION BY batch_id)"
    target = longest if multiple is None else f"CAST(ceil({longest} / {multiple}) AS BIGINT) * {multiple}"
    kind = f", array_to_string(list_concat([0 FOR z IN range(0, least(len(p), n))], [1 FOR z IN range(0, n - least(len(p), n))], {many('0', 't - n')}), ',') AS token_type_ids" if types else ""
    return f"""
    WITH {tokens or TOKENS},
    cut AS (SELECT *, {cut} AS ids FROM tokens),
    sized AS (SELECT *, CAST(len(ids) AS BIGINT) AS n, {skip} AS s FROM cut),
    target AS (SELECT *, {target} AS t FROM sized)
    SELECT {keys}, batch_id,
      array_to_string(list_concat(ids, {many('0', 't - n')}), ',') AS input_ids,
      array_to_string(list_concat({many('1', 'n')}, {many('0', 't - n')}), ',') AS attention_mask,
      array_to_string(list_concat({many('-100', 's')}, ids[s + 1:], {many('-100', 't - n')}), ',') AS labels,
      CAST(n - s AS INTEGER) AS n_loss_tokens{kind} FROM target"""


ORACLES["collate_prepared"] = f"""
WITH {DIALOGUES},
marked AS (
  SELECT *, CASE WHEN first_user AND NOT answer THEN repeat('{IMAGE_MARK}', CAST(conv_id % 3 AS INTEGER))
    || CASE WHEN conv_id % 4 = 0 THEN '{VIDEO_MARK}' ELSE '' END ELSE '' END || text AS body FROM last),
texts AS (
  SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch_id,
    coalesce(string_agg({chatml('role', 'body')}, '' ORDER BY turn) FILTER (NOT answer), '') || {ANSWER_HEADER} AS text,
    coalesce(string_agg(text || '<|im_end|>' || chr(10), '') FILTER (answer), '') AS next_text
  FROM marked GROUP BY conv_id),
tokens AS (
  SELECT conv_id, batch_id, [{WORD_ID} FOR w IN {WORDS.format('text')}] AS p, [{WORD_ID} FOR w IN {WORDS.format('next_text')}] AS c FROM texts),
sized AS (SELECT *, list_concat(p, c) AS ids, CAST(len(p) + len(c) AS BIGINT) AS n, CAST(len(p) AS BIGINT) AS s FROM tokens),
target AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS t FROM sized)
SELECT conv_id, batch_id, array_to_string(list_concat(ids, {many('0', 't - n')}), ',') AS input_ids,
  array_to_string(list_concat({many('1', 'n')}, {many('0', 't - n')}), ',') AS attention_mask,
  array_to_string(list_concat({many('-100', 's')}, c, {many('-100', 't - n')}), ',') AS labels,
  CAST(n - s AS INTEGER) AS n_loss_tokens FROM target"""
DIALOGUE_TOKENS = f"""{DIALOGUES},
texts AS (
  SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch_id,
    coalesce(string_agg({chatml('role', 'text')}, '' ORDER BY turn) FILTER (NOT answer), '') || {ANSWER_HEADER} AS text,
    coalesce(string_agg(text || '<|im_end|>' || chr(10), '') FILTER (answer), '') AS next_text
  FROM last GROUP BY conv_id),
tokens AS (
  SELECT conv_id, batch_id, next_text, [{WORD_ID} FOR w IN {WORDS.format('text')}] AS p, [{WORD_ID} FOR w IN {WORDS.format('next_text')}] AS c FROM texts)"""
ORACLES["collate_truncated_conversations"] = collated(150, 16, True, types=True, tokens=DIALOGUE_TOKENS, keys="conv_id")
ORACLES["collate_full_loss_conversations"] = collated(None, None, False, tokens=DIALOGUE_TOKENS, keys="conv_id")
ORACLES["flush_left_conversations"] = f"""
WITH {DIALOGUE_TOKENS}, longest AS (SELECT *, max(len(p)) OVER (PARTITION BY batch_id) AS t FROM tokens)
SELECT conv_id, array_to_string(list_concat(p, {many('0', 't - len(p)')}), ',') AS ids,
  array_to_string(list_concat({many('1', 'len(p)')}, {many('0', 't - len(p)')}), ',') AS mask FROM longest"""
ORACLES["suffix_trim_conversations"] = f"""
WITH {DIALOGUE_TOKENS} SELECT conv_id, next_text AS completion_text, array_to_string(c, ',') AS generated FROM tokens"""
ORACLES["collate_tokens"] = collated(None, None, True)
ORACLES["collate_truncated"] = collated(60, 16, True, types=True)
ORACLES["collate_full_loss"] = collated(None, None, False)
ORACLES["flush_left"] = f"""
WITH {TOKENS}, longest AS (SELECT *, max(len(p)) OVER (PARTITION BY batch_id) AS t FROM tokens)
SELECT conv_id, turn, array_to_string(list_concat(p, {many('0', 't - len(p)')}), ',') AS ids,
  array_to_string(list_concat({many('1', 'len(p)')}, {many('0', 't - len(p)')}), ',') AS mask FROM longest"""
ORACLES["batch_media_flags"] = """
SELECT batch_id, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_images, bool_and(n = 0) AS no_images
FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch_id, CASE WHEN lang = 'en' THEN 2 ELSE 0 END AS n
      FROM documents) GROUP BY batch_id"""

# --- evaluation ------------------------------------------------------------------------

ORACLES["argmax_scores"] = """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings"""


def vocabulary(table: str) -> str:
    return f"""vocab AS (
      SELECT {WORD_ID} AS id, min(w) AS token FROM (SELECT unnest({WORDS.format('text')}) AS w FROM {table}) GROUP BY 1)"""


ORACLES["decode_ids"] = f"""
WITH {TOKENS}, {vocabulary('conversations')},
flat AS (SELECT conv_id, turn, unnest(c) AS id, unnest(range(0, len(c))) AS i FROM tokens),
texts AS (
  SELECT conv_id, turn, string_agg(token, ' ' ORDER BY i) AS text FROM flat JOIN vocab USING (id) GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(text, '') AS text FROM tokens LEFT JOIN texts USING (conv_id, turn)"""
def numbered_words(least: int = 1) -> str:
    return f"""places AS (SELECT doc_id, unnest({WORDS.format('text')}) AS token, unnest(range(0, len({WORDS.format('text')}))) AS i FROM documents),
words AS (
  SELECT token, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 2 AS INTEGER) AS id
  FROM places GROUP BY token HAVING count(*) >= {least})"""


ORACLES["dictionary_words"] = f"WITH {numbered_words()} SELECT token, n, id FROM words"
ORACLES["dictionary_documents"] = f"""
WITH {numbered_words()},
coded AS (SELECT doc_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS ids FROM places JOIN words USING (token) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_ids, md5(coalesce(ids, '')) AS ids, md5(array_to_string({WORDS.format('text')}, ' ')) AS words
FROM documents LEFT JOIN coded USING (doc_id)"""
ORACLES["dictionary_rare"] = f"""
WITH {numbered_words(2)},
coded AS (
  SELECT doc_id, string_agg(CAST(coalesce(id, 1) AS VARCHAR), ',' ORDER BY i) AS ids, count(*) FILTER (id IS NULL) AS n_unknown
  FROM places LEFT JOIN words USING (token) GROUP BY doc_id)
SELECT doc_id, md5(coalesce(ids, '')) AS ids, coalesce(n_unknown, 0) AS n_unknown FROM documents LEFT JOIN coded USING (doc_id)"""
ORACLES["decode_conversations"] = f"""
WITH {DIALOGUE_TOKENS} SELECT conv_id, array_to_string({WORDS.format('next_text')}, ' ') AS text FROM tokens"""
ORACLES["decode_documents"] = f"""
WITH ids AS (SELECT doc_id, [{WORD_ID} FOR w IN {WORDS.format('text')}] AS c FROM documents), {vocabulary('documents')},
flat AS (SELECT doc_id, unnest(c) AS id, unnest(range(0, len(c))) AS i FROM ids),
texts AS (SELECT doc_id, string_agg(token, ' ' ORDER BY i) AS text FROM flat JOIN vocab USING (id) GROUP BY doc_id)
SELECT doc_id, CAST(len(c) AS BIGINT) AS n_ids, md5(coalesce(text, '')) AS digest FROM ids LEFT JOIN texts USING (doc_id)"""
METRICS = """count(*) AS n_rows, CAST(coalesce(sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_correct,
  coalesce(avg(CASE WHEN quality = toxic THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0) AS accuracy"""
ORACLES["accuracy"] = f"SELECT {METRICS} FROM labels"
ORACLES["accuracy_by_set"] = f"""
SELECT lang AS dataset, {METRICS} FROM documents JOIN labels USING (doc_id) GROUP BY lang"""
ORACLES["generation_trim"] = f"""
WITH {TOKENS} SELECT conv_id, turn, array_to_string(list_concat(p, c)[len(p) + 1:], ',') AS generated FROM tokens"""
ORACLES["batch_score"] = f"""
WITH {LABELLED}
SELECT doc_id, CASE WHEN length(text) > 500 THEN 'Fake' ELSE 'Real' END AS prediction,
  (length(text) > 500) = (label = 1) AS correct FROM labelled"""
ORACLES["mapped_rows"] = r"""
SELECT doc_id, upper(lang) AS lang, CAST(length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS BIGINT) AS n_letters
FROM documents"""
ORACLES["column_by_position"] = """
WITH first AS (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey),
l AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS i FROM customer
      WHERE c_custkey IN (SELECT o_custkey FROM first)),
r AS (SELECT first_order, row_number() OVER (ORDER BY first_order) AS i FROM first)
SELECT c_custkey, c_name, first_order FROM l JOIN r USING (i)"""
ORACLES["dataset_report"] = f"""
WITH {LABELLED}, tagged AS (
  SELECT dataset, label, CASE WHEN {gate('doc_id', 'split', 0.2)} THEN 'eval' ELSE 'train' END AS split FROM labelled)
SELECT dataset, split, CAST(coalesce(label, -1) AS BIGINT) AS label, count(*) AS n_rows, CAST(grouping(dataset, split, label) AS BIGINT) AS level
FROM tagged GROUP BY ROLLUP (dataset, split, label)"""

# --- streams ---------------------------------------------------------------------------

ORACLES["stream_prepare"] = f"""
SELECT row_number() OVER (ORDER BY rr, lang IS NOT DISTINCT FROM 'en') - 1 AS pos, CASE WHEN lang = 'en' THEN 'image' ELSE 'text' END || '/train/' || CAST(doc_id AS VARCHAR) AS example_id,
  CAST(doc_id % 2 AS INTEGER) AS label,
  '{QUESTION_HEAD}' || CASE WHEN lang = 'en' THEN 'image' ELSE 'video' END || '{QUESTION_TAIL}' AS prompt,
  CASE WHEN doc_id % 2 = 1 THEN 'Fake' ELSE 'Real' END AS completion,
  CASE WHEN lang IS DISTINCT FROM 'en' THEN CAST(strlen(text) AS BIGINT) ELSE -1 END AS video_bytes,
  CASE WHEN lang = 'en' THEN CAST(strlen(text) AS BIGINT) ELSE -1 END AS image_bytes
FROM (SELECT *, row_number() OVER (PARTITION BY lang IS NOT DISTINCT FROM 'en' ORDER BY doc_id) AS rr FROM documents)"""
ORACLES["stream_accuracy"] = f"SELECT lang, {METRICS} FROM documents JOIN labels USING (doc_id) GROUP BY lang"
