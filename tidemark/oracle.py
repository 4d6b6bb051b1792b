"""The catalogue's queries in SQL, written from the definitions and not from the DataFrames."""

from __future__ import annotations

from tidemark import constants as C


def db(x: str) -> str:
    return f"round(CASE WHEN {x} > 0 THEN 20 * log10({x} / 500) ELSE -120 END, 6)"


def ramp(x: str, full: float, zero: float) -> str:
    return f"greatest(0, least(1, ({x} - ({zero})) / (({full}) - ({zero}))))"


def rank(values: str, percent: float) -> str:
    return f"coalesce({values}[CAST(floor({percent} / 100.0 * (len({values}) - 1)) AS BIGINT) + 1], 0)"


FLUX = "CASE WHEN {x} <= 0.004 THEN 1 WHEN {x} <= 0.01 THEN 1 - ({x} - 0.004) / 0.006 * 0.3 WHEN {x} <= 0.02 THEN 0.7 - ({x} - 0.01) / 0.01 * 0.3 WHEN {x} <= 0.03 THEN 0.4 - ({x} - 0.02) / 0.01 * 0.2 ELSE 0.2 END"
ROLLOFF = "CASE WHEN {x} BETWEEN 4000 AND 8000 THEN 1 WHEN {x} >= 2500 AND {x} < 4000 THEN 0.5 + 0.5 * ({x} - 2500) / 1500 WHEN {x} > 8000 AND {x} <= 10000 THEN 0.5 + 0.5 * (10000 - {x}) / 2000 ELSE 0 END"
SNR = "CASE WHEN {x} <= 0 THEN 0 WHEN {x} >= 40 THEN 1 WHEN {x} < 20 THEN 0.5 * {x} / 20 ELSE 0.5 + 0.5 * ({x} - 20) / 20 END"
WINDOW = (
    f"0.15 * greatest(0, least(1, k / 7.5)) + 0.1 * greatest(0, least(1, 1 - f)) + 0.1 * CASE WHEN c BETWEEN 200 AND 6000 THEN 1 - abs(c - 3100) / 2900 * 0.5 ELSE 0 END"
    f" + 0.1 * greatest(0, least(1, 1 - kv / 100)) + 0.1 * CASE WHEN r > -30 THEN greatest(0, least(1, (r + 30) / 18)) ELSE 0 END + 0.15 * greatest(0, least(1, v / 0.6)) + 0.15 * ({ROLLOFF.format(x='ro')}) + 0.15 * ({FLUX.format(x='fl')})"
)
SAMPLE = "count(*) AS n, avg(rms_level) AS rms_level, var_pop(momentary) AS variance"
SCORE = f"round(0.6 * coalesce({SNR.format(x='(rms_level - floor)')}, 1) + 0.4 * least((\"end\" - start) / 3600 * 2.0 / 30, 1) + 0.02 * greatest(0, least(1, 1 - variance / 25)), 9)"

EVENTS = f"""WITH RECURSIVE
iv AS (SELECT event_type AS series_id, CAST(date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) * 3600 AS BIGINT) AS ts, count(*) AS n,
  {db('sqrt(avg(value * value))')} AS rms_level, {db('max(abs(value))')} AS peak_level, {db('avg(abs(value))')} AS momentary,
  round(avg(user_id % 97) * 100, 9) AS centroid, round(avg(user_id % 10) * 0.08, 9) AS entropy, round(avg(user_id % 13), 9) AS kurtosis,
  round(avg(user_id % 7) * 0.1, 9) AS flatness, round(avg(user_id % 89) * 100 + 1000, 9) AS rolloff, round(avg(user_id % 31) * 0.001, 9) AS flux
  FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
med AS (SELECT series_id, list_sort(list(momentary))[count(*) // 2 + 1] AS level_p50, list_sort(list(flux))[count(*) // 2 + 1] AS flux_p50 FROM iv GROUP BY 1),
likely AS (SELECT series_id, ts, momentary, round(0.6 * CASE WHEN momentary > level_p50 THEN greatest(0, 1 - (momentary - level_p50) / 6) ELSE 1 END
  + 0.4 * CASE WHEN flux_p50 > 0 AND flux > flux_p50 THEN flux_p50 / flux ELSE 1 END, 9) AS score FROM iv JOIN med USING (series_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, momentary, ts) AS place, count(*) OVER (PARTITION BY series_id) AS n FROM likely),
seed AS (SELECT series_id, max(momentary) FILTER (place <= least(n, greatest(n // 5, 8)) AND momentary > -115 AND n >= 10) AS seed FROM placed GROUP BY 1),
lv AS (SELECT series_id, list_sort(list(momentary) FILTER (momentary > -115)) AS v, avg(CASE WHEN momentary <= -115 THEN 1.0 ELSE 0.0 END) AS floored_share FROM iv GROUP BY 1),
ends AS (SELECT series_id, min(momentary) AS low, max(momentary) AS high FROM iv WHERE momentary > -115 GROUP BY 1),
bins AS (SELECT series_id, CAST(least(floor(momentary - low), floor(high - low)) AS BIGINT) AS bin, count(*) AS n, low, high FROM iv JOIN ends USING (series_id) WHERE momentary > -115 GROUP BY ALL),
sums AS (SELECT *, sum(n) OVER w AS wb, sum(n * (low + bin + 0.5)) OVER w AS sb, sum(n) OVER (PARTITION BY series_id) AS wt, sum(n * (low + bin + 0.5)) OVER (PARTITION BY series_id) AS st FROM bins WINDOW w AS (PARTITION BY series_id ORDER BY bin)),
between_classes AS (SELECT *, round(wb * (wt - wb) * (sb / wb - (st - sb) / (wt - wb)) * (sb / wb - (st - sb) / (wt - wb)), 6) AS v FROM sums WHERE wt > wb),
best AS (SELECT series_id, bin FROM between_classes WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY v DESC, bin) = 1),
otsu AS (SELECT series_id, coalesce(low + bin + 1, (low + high) / 2) AS split, low, high FROM ends LEFT JOIN best USING (series_id)),
base AS (SELECT series_id, coalesce(seed, -115) AS seed, coalesce(split, 0) AS raw_split, floored_share, {rank('v', 75)} AS p75, {rank('v', 10)} AS p10 FROM lv LEFT JOIN seed USING (series_id) LEFT JOIN otsu USING (series_id)),
clamped AS (SELECT *, CASE WHEN p75 < seed + 2 THEN seed + 2 ELSE greatest(seed + 2, least(p75, raw_split)) END AS split, greatest(p10, seed + 2) AS floor FROM base),
upper_mode AS (SELECT series_id, sum((low + bin + 0.5) * n) / sum(n) AS u FROM bins JOIN clamped USING (series_id) WHERE low + bin + 0.5 >= split GROUP BY 1),
limits AS (SELECT clamped.*, coalesce(u, split) AS upper_mode, CASE WHEN coalesce(u, split) > split THEN (u - split) * 0.25 ELSE 1 END AS margin FROM clamped LEFT JOIN upper_mode USING (series_id)),
flags AS (SELECT iv.*, split, margin, floor, centroid BETWEEN 200 AND 6000 AND entropy < 0.7 AS ok, momentary >= split AND centroid BETWEEN 200 AND 6000 AND entropy < 0.7 AS speech,
  row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM iv JOIN limits USING (series_id)),
gaps AS (SELECT series_id, i - lag(i) OVER (PARTITION BY series_id ORDER BY i) - 1 AS gap FROM flags WHERE speech),
tol AS (SELECT series_id, greatest(2, least(10, CAST(round(coalesce({rank('list_sort(list(gap) FILTER (gap > 0))', 75)}, 0)) AS BIGINT))) AS tolerance FROM (SELECT DISTINCT series_id FROM iv) LEFT JOIN gaps USING (series_id) GROUP BY 1),
steps AS (SELECT f.*, tolerance FROM flags f JOIN tol USING (series_id)),
fsm AS (
  SELECT series_id, CAST(0 AS BIGINT) AS i, false AS is_on, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS gap, CAST(NULL AS BIGINT) AS out_start, CAST(NULL AS BIGINT) AS out_last, CAST(NULL AS BIGINT) AS out_n FROM (SELECT DISTINCT series_id FROM iv)
  UNION ALL
  SELECT series_id, i, CASE WHEN NOT was THEN enters ELSE NOT ends END, CASE WHEN was THEN start ELSE ts END, CASE WHEN NOT was THEN 1 WHEN goes THEN held + 1 ELSE held END, CASE WHEN NOT was OR goes THEN ts ELSE last END,
    CASE WHEN NOT was OR goes THEN 0 WHEN lower THEN gap + 1 ELSE gap END, CASE WHEN was AND ends THEN start END, CASE WHEN was AND ends THEN last END, CASE WHEN was AND ends THEN held END
  FROM (SELECT s.series_id, s.i, s.ts, f.is_on AS was, f.start, f.held, f.last, f.gap, s.momentary >= split + margin AND ok AS enters, s.momentary >= split AND ok AS goes, s.momentary < split - margin AS lower,
      (s.momentary >= split AND NOT ok) OR (s.momentary < split - margin AND f.gap + 1 > tolerance) AS ends
    FROM fsm f JOIN steps s ON s.series_id = f.series_id AND s.i = f.i + 1)),
closed AS (SELECT series_id, out_start AS start, out_last AS last, out_n AS n FROM fsm WHERE out_start IS NOT NULL
  UNION ALL SELECT series_id, start, last, held FROM (SELECT * FROM fsm QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY i DESC) = 1) WHERE is_on),
runs AS (SELECT series_id, start, last + 3600 AS "end", n AS intervals FROM closed WHERE n >= 4),
islands AS (SELECT series_id, min(ts) AS start, max(ts) + 3600 AS "end" FROM (SELECT *, i - row_number() OVER (PARTITION BY series_id ORDER BY i) AS g FROM flags WHERE momentary < split) GROUP BY series_id, g),
quiet AS (SELECT * FROM islands QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY "end" - start DESC, start) = 1),
quiet_rows AS (SELECT q.series_id, q.start, q."end", ts, rms_level, count(*) OVER (PARTITION BY q.series_id) AS n, row_number() OVER (PARTITION BY q.series_id ORDER BY ts) AS r,
  round(avg(rms_level) OVER (PARTITION BY q.series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 9) AS s FROM quiet q JOIN iv ON iv.series_id = q.series_id AND ts >= q.start AND ts < q."end" WHERE q."end" - q.start > 6 * 3600),
quiet_best AS (SELECT * FROM quiet_rows WHERE n >= 4 AND r <= n - least(n, 6) + 1 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY s, ts) = 1),
noise AS (SELECT q.series_id, coalesce(b.ts, q.start) AS start, coalesce(b.ts + least(b.n, 6) * 3600, q."end") AS "end", b.ts IS NOT NULL AS refined, q.start AS original_start, q."end" AS original_end FROM quiet q LEFT JOIN quiet_best b USING (series_id)),
floors AS (SELECT series_id, floor FROM limits JOIN quiet USING (series_id)),
samples AS (SELECT r.series_id, r.start, r."end", count(*) AS intervals, greatest(-120, max(peak_level)) AS peak_level, avg(CASE WHEN kurtosis > 4.5 THEN 1.0 ELSE 0.0 END) AS voicing, var_pop(momentary) AS level_variance,
  avg(rms_level) AS rms_level, avg(momentary) AS momentary, avg(centroid) AS centroid, avg(entropy) AS entropy, avg(kurtosis) AS kurtosis, avg(flatness) AS flatness, avg(rolloff) AS rolloff, avg(flux) AS flux
  FROM runs r JOIN iv ON iv.series_id = r.series_id AND ts >= r.start AND ts < r."end" GROUP BY ALL),
scored AS (SELECT series_id, start, "end", {SCORE} AS score FROM (SELECT s.*, level_variance AS variance, floor FROM samples s LEFT JOIN floors USING (series_id))),
elected AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY score >= 0.3 DESC, score DESC, start) = 1),
speech_rows AS (SELECT e.series_id, ts, count(*) OVER (PARTITION BY e.series_id) AS n, row_number() OVER (PARTITION BY e.series_id ORDER BY ts) AS i, avg(kurtosis) OVER w AS k, avg(flatness) OVER w AS f, avg(centroid) OVER w AS c, avg(rms_level) OVER w AS r,
  avg(rolloff) OVER w AS ro, avg(flux) OVER w AS fl, var_pop(kurtosis) OVER w AS kv, avg(CASE WHEN kurtosis > 4.5 THEN 1.0 ELSE 0.0 END) OVER w AS v
  FROM elected e JOIN iv ON iv.series_id = e.series_id AND ts >= e.start AND ts < e."end" WHERE e."end" - e.start > 12 * 3600 WINDOW w AS (PARTITION BY e.series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
speech_best AS (SELECT * FROM speech_rows WHERE n >= 6 AND i <= n - least(n, 12) + 1 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round({WINDOW}, 9) DESC, ts) = 1),
refined AS (SELECT e.series_id, coalesce(b.ts, e.start) AS start, coalesce(b.ts + least(b.n, 12) * 3600, e."end") AS "end", b.ts IS NOT NULL AS refined, e.start AS original_start, e."end" AS original_end FROM elected e LEFT JOIN speech_best b USING (series_id)),
again AS (SELECT r.*, floor, rms_level, variance FROM (SELECT r.series_id, r.start, r."end", r.refined, r.original_start, r.original_end, {SAMPLE} FROM refined r JOIN iv ON iv.series_id = r.series_id AND ts >= r.start AND ts < r."end" GROUP BY ALL) r LEFT JOIN floors USING (series_id)),
voiced AS (SELECT f.series_id, list_sort(list(momentary)) AS w FROM flags f JOIN elected e ON e.series_id = f.series_id AND ts >= e.start AND ts < e."end" WHERE speech GROUP BY 1),
below AS (SELECT series_id, list_sort(list(momentary) FILTER (momentary > -115 AND momentary < split)) AS v FROM flags GROUP BY 1),
gate AS (SELECT series_id, {rank('w', 10)} AS voiced_low, {rank('v', 95)} AS noise_high FROM below LEFT JOIN voiced USING (series_id)),
staged AS (SELECT series_id, ['input', 'filtered', 'final'][ts % 86400 // 28800 + 1] AS stage, round(avg(rms_level) + 3e-11, 6) AS rms_level, round(avg(peak_level) + 3e-11, 6) AS peak_level, round(avg(momentary) + 3e-11, 6) AS momentary, round(avg(kurtosis) + 3e-11, 6) AS kurtosis, round(avg(flatness) + 3e-11, 6) AS flatness, round(avg(flux) + 3e-11, 6) AS flux FROM iv GROUP BY ALL),
long_stage AS (UNPIVOT staged ON rms_level, peak_level, momentary, kurtosis, flatness, flux INTO NAME metric VALUE value),
aligned AS (SELECT series_id, metric, max(value) FILTER (stage = 'input') AS "input", max(value) FILTER (stage = 'filtered') AS filtered, max(value) FILTER (stage = 'final') AS final FROM long_stage GROUP BY ALL),
summary_rows AS (SELECT series_id, count(*) AS intervals, list_sort(list(rms_level) FILTER (rms_level > -120)) AS v FROM iv GROUP BY 1),
rms_gaps AS (SELECT series_id, rms_level AS high, lag(rms_level) OVER (PARTITION BY series_id ORDER BY rms_level) AS low FROM iv WHERE rms_level > -120),
widest AS (SELECT *, high - low AS gap FROM rms_gaps WHERE low IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY high - low DESC, low) = 1)
"""

MEASURED = """WITH m0 AS (SELECT o_custkey AS series_id, CAST(sum(o_orderkey % 1000) AS BIGINT) AS s FROM orders GROUP BY 1),
m AS (SELECT series_id, s, -45.0::DOUBLE + (s % 97) * (37.0::DOUBLE / 97) AS integrated, -20.0::DOUBLE + (s % 89) * (22.0::DOUBLE / 89) AS peak, 2.0::DOUBLE + (s % 83) * (23.0::DOUBLE / 83) AS range_lu,
  -90.0::DOUBLE + (s % 79) * (60.0::DOUBLE / 79) AS floor, -60.0::DOUBLE + (s % 73) * (40.0::DOUBLE / 73) AS voiced_low, (s % 71) * (40.0::DOUBLE / 71) AS separation, -40.0::DOUBLE + (s % 67) * (40.0::DOUBLE / 67) AS body_db,
  -40.0::DOUBLE + (s % 61) * (40.0::DOUBLE / 61) AS sibilant_db, -45.0::DOUBLE + (s % 59) * (35.0::DOUBLE / 59) AS speech_rms, -50.0::DOUBLE + (s % 53) * (38.0::DOUBLE / 53) AS file_rms, 5.0::DOUBLE + (s % 47) * (25.0::DOUBLE / 47) AS room_crest,
  -60.0::DOUBLE + (s % 43) * (40.0::DOUBLE / 43) AS room_peak, (s % 41) * (1.0::DOUBLE / 41) AS room_flatness, -70.0::DOUBLE + (s % 37) * (50.0::DOUBLE / 37) AS rms_trough, s % 5 <> 0 AS has_speech, s % 7 <> 0 AS has_bands, s % 11 = 0 AS voice_activated,
  len(list_filter(range(15), lambda b: (s + b) % 17 <> 0)) AS finite_bands FROM m0),
den AS (SELECT *, NOT voice_activated AS denoise_on FROM m),
gate0 AS (SELECT *, CASE WHEN range_lu > 15 THEN 1.5 ELSE 2.0 END AS gate_ratio, has_speech AND separation < 12 AS narrow FROM m),
gate AS (SELECT *, CASE WHEN has_speech THEN voiced_low - 6 WHEN room_crest > 20 AND room_peak <> 0 AND greatest(0, -16 - integrated) < 25 THEN room_peak + 3 ELSE greatest(-40, floor + 12 / (1 - 1 / gate_ratio)) END AS free FROM gate0),
tuned AS (SELECT *, greatest(-80, least(-25, free)) AS gate_db, CASE WHEN narrow THEN 8.0 ELSE 14.0 END AS depth,
  CASE WHEN NOT has_bands OR sibilant_db - body_db < -6 THEN 0 WHEN sibilant_db - body_db < -3 THEN (sibilant_db - body_db + 6) / 3 * 0.6 WHEN sibilant_db - body_db < 0 THEN 0.6 + (sibilant_db - body_db + 3) / 3 * 0.25 ELSE 0.85 END AS deess,
  greatest(-45, least(-6, CASE WHEN has_speech THEN greatest(speech_rms, file_rms) + 9 ELSE peak - 20 END)) AS comp FROM gate),
lim AS (SELECT *, -16 - integrated AS gain_db, -1 - (-16 - integrated) AS free, peak + (-16 - integrated) > -1 AS needed, peak + (-16 - integrated) + 0.3 AS inner_peak FROM m)
"""

SPECTRA = """WITH bin AS (SELECT label, vec_id, unnest(range(len(embedding))) AS i, abs(CAST(unnest(embedding) AS DOUBLE)) AS v, len(embedding) AS n FROM embeddings),
b1 AS (SELECT vec_id, label, n, sum(v) AS s, avg(v) AS mean, sum(v * i * 8000.0 / n) / sum(v) AS centroid FROM bin GROUP BY ALL),
b2 AS (SELECT b.vec_id, sqrt(sum(v * pow(i * 8000.0 / b.n - centroid, 2)) / any_value(s)) AS spread FROM bin b JOIN b1 USING (vec_id) GROUP BY 1),
st AS (SELECT b.vec_id, any_value(b.label) AS label, any_value(mean) AS mean, avg((v - mean) * (v - mean)) AS variance, any_value(centroid) AS centroid, any_value(spread) AS spread,
  sum(v * pow(i * 8000.0 / b.n - centroid, 3)) / any_value(s * pow(spread, 3)) AS skewness, sum(v * pow(i * 8000.0 / b.n - centroid, 4)) / any_value(s * pow(spread, 4)) AS kurtosis,
  -sum(v * ln(v + 1.1920928955078125e-07)) / ln(any_value(b.n)) AS entropy, exp(avg(ln(v + 1.1920928955078125e-07))) / avg(v + 1.1920928955078125e-07) AS flatness, max(v) / any_value(mean) AS crest,
  sum((i - b.n / 2) / (b.n / 2) * (v - mean)) / sum(pow((i - b.n / 2) / (b.n / 2), 2)) AS slope FROM bin b JOIN b1 USING (vec_id) JOIN b2 USING (vec_id) GROUP BY 1),
dec AS (SELECT b.vec_id, sum((v - first) / i) / sum(v) AS decrease FROM bin b JOIN (SELECT vec_id, v AS first FROM bin WHERE i = 0) USING (vec_id) WHERE i > 0 GROUP BY 1),
cum AS (SELECT vec_id, i, n, sum(v) OVER (PARTITION BY vec_id ORDER BY i) AS c, sum(v) OVER (PARTITION BY vec_id) AS t FROM bin),
roll AS (SELECT vec_id, min(i) * 8000.0 / any_value(n) AS rolloff FROM cum WHERE c >= 0.85 * t GROUP BY 1),
prev AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings WHERE embedding IS NOT NULL),
flux AS (SELECT b.vec_id, sqrt(sum(pow(b.v - coalesce(p.v, 0), 2))) AS flux FROM bin b JOIN prev USING (vec_id) LEFT JOIN bin p ON p.vec_id = before AND p.i = b.i GROUP BY 1)
"""

CELL = {
    "dBFS": "CASE WHEN {x} IS NULL THEN '-' WHEN {x} <= -120 THEN '< -120' ELSE printf('%.1f', round({x}, 1)) END",
    "LUFS": "CASE WHEN {x} IS NULL THEN '-' WHEN {x} < -70 THEN '< -70' ELSE printf('%.1f', round({x}, 1)) END",
    "": "CASE WHEN {x} IS NULL THEN '-' WHEN abs({x}) > 0 AND abs({x}) < 0.0001 THEN printf('%.2e', {x}) ELSE printf('%.4f', round({x}, 4)) END",
}
METRICS = "(VALUES ('rms_level', 'RMS level', 'dBFS', 'mean level of the series'), ('peak_level', 'Peak level', 'dBFS', 'highest level of any interval'), ('momentary', 'Momentary loudness', 'LUFS', 'mean momentary loudness'), ('kurtosis', 'Kurtosis', '', 'peakedness of the spectrum'), ('flatness', 'Flatness', '', 'noise-like against tonal'), ('flux', 'Flux', '', 'change between intervals')) AS d(metric, label, unit, meaning)"


DURATION = "CASE WHEN {x} < 60 THEN printf('%.1fs', {x}) WHEN {x} < 3600 THEN printf('%dm %ds', CAST(floor({x}) AS BIGINT) // 60, CAST(floor({x}) AS BIGINT) % 60) ELSE printf('%dh %dm %ds', CAST(floor({x}) AS BIGINT) // 3600, CAST(floor({x}) AS BIGINT) % 3600 // 60, CAST(floor({x}) AS BIGINT) % 60) END"
ADVICE = "CASE WHEN peak >= 0 THEN 'Clipping. ' WHEN peak > -1 THEN 'Hot. ' WHEN peak < -12 THEN 'Quiet. ' ELSE 'Level well set. ' END || printf('Peaks at %+.1f ㏈TP. ', peak) || CASE WHEN peak > -1 THEN printf('Lower input gain ~%.0f ㏈.', abs(round(-6 - peak))) WHEN peak < -12 THEN printf('Raise input gain ~%.0f ㏈.', abs(round(-6 - peak))) ELSE 'No action required.' END"

CHAIN_START = "'aformat=channel_layouts=mono', 'highpass=f=80:poles=2:width_type=q:width=0.707:normalize=1:a=tdii', 'lowpass=f=20500:poles=2:width_type=q:width=0.707:normalize=1:a=tdii'"
CHAIN_DYNAMICS = "printf('agate=threshold=%.6f:ratio=%.1f:attack=5.00:release=200:range=%.4f:knee=3.0:detection=rms:makeup=1.0', pow(10, gate_db / 20), CAST(gate_ratio AS DOUBLE), pow(10, -depth / 20)), printf('acompressor=threshold=%.6f:ratio=3.0:attack=10:release=200:makeup=1.00:knee=4.0:detection=rms:mix=1.00', pow(10, comp / 20)), CASE WHEN deess > 0 THEN printf('deesser=i=%.2f:m=0.50:f=0.80', CAST(deess AS DOUBLE)) END"
CHAIN_END = "'aformat=sample_rates=44100:channel_layouts=mono:sample_fmts=s16,asetnsamples=n=4096'"
BANDS = "list_transform(range(15), lambda b: CASE WHEN (s + b) % 17 <> 0 THEN -60.0::DOUBLE + (s * (b + 1)) % 31 END)"
SHAPE = f"array_to_string(list_transform({BANDS}, lambda v: printf('%.1f', CASE WHEN v IS NULL THEN 0.0 ELSE greatest(-24, least(24, v - list_avg({BANDS}))) END::DOUBLE)), '|')"
DENOISE = f"'anlmdn=s=0.00001:p=0.0060:r=0.0020:m=3', CASE WHEN NOT voice_activated THEN concat('afftdn=nr=12:nt=', CASE WHEN finite_bands >= 10 AND separation >= 12 AND room_flatness >= 0.45 THEN 'custom:bn=' || {SHAPE} ELSE 'w' END, ':tn=0:nf=', regexp_replace(CAST(greatest(-80, least(-20, floor)) AS VARCHAR), '\\.0$', '')) END"
ANALYSIS = "'astats=metadata=1:measure_perchannel=all,aspectralstats=win_size=2048:win_func=hann:measure=all,ebur128=metadata=1:peak=sample+true:dualmono=true:target=-16'"


def chain(*steps: str) -> str:
    return f"SELECT series_id, concat_ws(',', {', '.join(steps)}) AS spec FROM tuned"


def cell(x: str) -> str:
    return "CASE " + " ".join(f"WHEN unit = '{unit}' THEN {text.format(x=x)}" for unit, text in CELL.items()) + f" END AS {x}"


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


ORACLE_SQL: dict[str, str] = {name: EVENTS + sql for name, sql in {
    "interval_rollup": "SELECT * FROM iv",
    "silence_medians": "SELECT * FROM med",
    "noise_floor_seed": "SELECT series_id, round(coalesce(seed, -115), 6) AS seed, round(seed + 1, 6) AS threshold FROM seed",
    "level_histogram": "SELECT * FROM bins",
    "otsu_split": f"SELECT series_id, {r6('split', 'low', 'high')} FROM otsu",
    "thresholds": f"SELECT series_id, {r6('seed', 'raw_split', 'split', 'floor', 'floored_share', 'upper_mode', 'margin')}, floored_share >= 0.2 AS voice_activated FROM limits",
    "interval_summary": f"SELECT series_id, intervals, {r6('lowest', 'p10', 'p25', 'p50', 'p75', 'p90', 'widest_gap', 'gap_low', 'gap_high')} FROM (SELECT s.series_id, intervals, v[1] AS lowest, v[len(v) // 10 + 1] AS p10, v[len(v) // 4 + 1] AS p25, v[len(v) // 2 + 1] AS p50, v[len(v) * 3 // 4 + 1] AS p75, v[len(v) * 9 // 10 + 1] AS p90, gap AS widest_gap, low AS gap_low, high AS gap_high FROM (SELECT series_id, intervals, CASE WHEN len(v) >= 10 THEN v END AS v FROM summary_rows) s LEFT JOIN widest w ON w.series_id = s.series_id AND v IS NOT NULL)",
    "speech_flags": "SELECT series_id, ts, speech FROM flags",
    "gap_tolerance": "SELECT * FROM tol",
    "speech_runs": "SELECT * FROM runs",
    "longest_quiet_run": "SELECT * FROM quiet",
    "noise_region": "SELECT * FROM noise",
    "region_samples": f"SELECT series_id, start, \"end\", intervals, {r6('peak_level', 'voicing', 'level_variance', 'rms_level', 'momentary', 'centroid', 'entropy', 'kurtosis', 'flatness', 'rolloff', 'flux').replace(', 6)', ' + 3e-11, 9)')} FROM samples",
    "noise_profile": "SELECT n.series_id, n.start, n.\"end\", round(any_value(floor), 6) AS floor, round(greatest(-120, max(peak_level)), 6) AS peak_level, round(greatest(-120, max(peak_level)) - avg(rms_level), 6) AS crest, round(avg(entropy), 6) AS entropy, CASE WHEN (n.\"end\" - n.start) / 3600 * 2.0 < 8 THEN printf('using short room tone region (%.1fs) - ideally need >=8s', (n.\"end\" - n.start) / 3600 * 2.0::DOUBLE) WHEN (n.\"end\" - n.start) / 3600 * 2.0 > 18 THEN printf('using long room tone region (%.1fs) - ideally <=18s', (n.\"end\" - n.start) / 3600 * 2.0::DOUBLE) END AS warning FROM noise n JOIN iv ON iv.series_id = n.series_id AND iv.ts >= n.start AND iv.ts < n.\"end\" JOIN limits l ON l.series_id = n.series_id GROUP BY ALL",
    "room_tone_samples": "SELECT n.series_id, round(avg(rms_level) + 3e-11, 9) AS rms_level, round(greatest(-120, max(peak_level)) + 3e-11, 9) AS peak_level, round(greatest(-120, max(peak_level)) - avg(rms_level) + 3e-11, 9) AS crest, round(avg(momentary) + 3e-11, 9) AS momentary, round(avg(entropy) + 3e-11, 9) AS entropy, round(avg(centroid) + 3e-11, 9) AS centroid FROM noise n JOIN iv ON iv.series_id = n.series_id AND iv.ts >= n.start AND iv.ts < n.\"end\" GROUP BY 1",
    "region_stages": "SELECT r.series_id, stage, count(*) AS intervals, round(avg(momentary + g) + 3e-11, 9) AS momentary, round(avg(rms_level) + 3e-11, 9) AS rms_level FROM elected r JOIN iv ON iv.series_id = r.series_id AND iv.ts >= r.start AND iv.ts < r.\"end\", (VALUES ('input', 0.0::DOUBLE), ('filtered', 3.0), ('final', 6.0)) AS t(stage, g) GROUP BY 1, 2",
    "candidate_counts": "SELECT series_id, count(*) AS candidates FROM runs GROUP BY 1",
    "candidate_scores": f"SELECT series_id, start, \"end\", {r6('score')} FROM scored",
    "elected_region": f"SELECT series_id, start, \"end\", {r6('score')} FROM elected",
    "refined_region": f"SELECT series_id, start, \"end\", refined, original_start, original_end, round({SCORE}, 6) AS score FROM again",
    "gate_statistics": f"SELECT series_id, {r6('voiced_low', 'noise_high')}, round(voiced_low - noise_high, 6) AS separation FROM gate",
    "stage_alignment": f"SELECT series_id, metric, {r6('\"input\"', 'filtered', 'final')} FROM aligned",
    "metric_report_rows": f"SELECT series_id, metric, label, unit, meaning, {cell('\"input\"')}, {cell('filtered')}, {cell('final')} FROM aligned JOIN {METRICS} USING (metric)",
    "markdown_report": f"SELECT series_id, concat('| Metric | Input | Filtered | Final | Unit | Meaning |', chr(10), '|---|---|---|---|---|---|', chr(10), array_to_string(list_sort(list(concat('| ', label, ' | ', \"input\", ' | ', filtered, ' | ', final, ' | ', coalesce(nullif(unit, ''), '-'), ' | ', meaning, ' |'))), chr(10))) AS markdown FROM (SELECT series_id, label, unit, meaning, {cell('\"input\"')}, {cell('filtered')}, {cell('final')} FROM aligned JOIN {METRICS} USING (metric)) GROUP BY 1",
}.items()}
ORACLE_SQL |= {name: SPECTRA + sql for name, sql in {
    "spectral_moments": f"SELECT vec_id, {r6('mean', 'variance', 'centroid', 'spread', 'skewness', 'kurtosis')} FROM st",
    "spectral_shape": f"SELECT vec_id, {r6('entropy', 'flatness', 'crest', 'slope', 'decrease', 'rolloff')} FROM st JOIN dec USING (vec_id) JOIN roll USING (vec_id)",
    "spectral_flux": "SELECT vec_id, round(flux, 6) AS flux FROM flux",
    "region_spectral_mean": "SELECT CAST(label AS VARCHAR) AS series_id, round(avg(centroid), 6) AS centroid, round(avg(entropy), 6) AS entropy, round(avg(flatness), 6) AS flatness, round(avg(crest), 6) AS crest FROM st GROUP BY 1",
}.items()}
ORACLE_SQL |= {name: MEASURED + sql for name, sql in {
    "scalar_functions": f"SELECT series_id, round(pow(10, peak / 20), 6) AS linear, round(CASE WHEN peak > 0 THEN 20 * log10(peak) ELSE -120 END, 6) AS db, round(CASE WHEN peak = 0 THEN -120 ELSE 20 * log10(least(1, CASE WHEN abs(peak * 100) > 1 THEN abs(peak * 100) / 32768 ELSE abs(peak * 100) END)) END, 6) AS sample_db, round({ramp('peak', -6, -1)}, 6) AS score, CASE WHEN integrated > -20 THEN 'loud' WHEN integrated > -30 THEN 'mid' ELSE 'quiet' END AS tier, round(least(-35, greatest(-70, floor + 6)), 6) AS silence, CAST((CAST(trunc(range_lu * 1000) AS BIGINT) + 125) // 250 AS BIGINT) AS hops, round({ROLLOFF.format(x='(range_lu * 500)')}, 6) AS rolloff, round({FLUX.format(x='(range_lu / 700)')}, 6) AS flux, round({SNR.format(x='separation')}, 6) AS snr, round(CASE WHEN peak < -12 THEN {ramp('peak', -12, -24)} * 0.33 WHEN peak <= -1 THEN 0.33 + {ramp('peak', -1, -12)} * 0.34 ELSE 0.67 + {ramp('peak', 1, -1)} * 0.33 END, 6) AS place FROM m",
    "input_noise_floor": "SELECT series_id, round(floor, 6) AS floor, floor_source, round(CASE WHEN has_bands THEN greatest(0, least(60, file_rms - floor)) WHEN integrated > -20 THEN 40 WHEN integrated > -30 THEN 25 ELSE 15 END, 6) AS reduction_headroom FROM (SELECT series_id, file_rms, has_bands, integrated, greatest(-90, least(-30, CASE WHEN has_speech THEN rms_trough WHEN has_bands THEN file_rms - 15 ELSE integrated - 10 - CASE WHEN integrated > -20 THEN 18 WHEN integrated > -30 THEN 12 ELSE 8 END END)) AS floor, CASE WHEN has_speech THEN 'levels' WHEN has_bands THEN 'rms_estimate' ELSE 'loudness_estimate' END AS floor_source FROM m)",
    "adaptive_denoise": "SELECT series_id, denoise_on, round(CASE WHEN denoise_on THEN greatest(-80, least(-20, floor)) ELSE 0 END, 6) AS denoise_floor, NOT denoise_on AS track_noise, CASE WHEN denoise_on AND finite_bands >= 10 AND separation >= 12 AND room_flatness >= 0.45 THEN 'custom' ELSE 'w' END AS noise_type FROM den",
    "adaptive_gate": "SELECT series_id, round(gate_db, 6) AS gate_threshold_db, CASE WHEN has_speech THEN round(free, 6) ELSE 0 END AS gate_unclamped_db, CAST(gate_ratio AS DOUBLE) AS gate_ratio, CAST(depth AS DOUBLE) AS gate_depth_db, CASE WHEN NOT has_speech THEN '' WHEN narrow THEN 'narrow_gap' ELSE 'none' END AS gate_reason, round(CASE WHEN has_speech THEN voiced_low - gate_db ELSE 0 END, 6) AS gate_headroom_db FROM tuned",
    "adaptive_deesser": "SELECT series_id, round(deess, 6) AS deess_intensity FROM tuned",
    "adaptive_compressor": "SELECT series_id, round(comp, 6) AS compressor_threshold_db FROM tuned",
    "filter_spec": chain(CHAIN_START, CHAIN_DYNAMICS, CHAIN_END),
    "filter_chain": chain(CHAIN_START, DENOISE, CHAIN_DYNAMICS, ANALYSIS, CHAIN_END),
    "text_formats": f"SELECT series_id, CASE WHEN integrated * 3 <= -120 THEN '< -120' ELSE printf('%.1f', integrated * 3) END AS db, CASE WHEN integrated * 2 < -70 THEN '< -70' ELSE printf('%.1f', integrated * 2) END AS lufs, printf('%+.1f', peak) AS signed, {DURATION.format(x='(range_lu * 300)')} AS duration, CASE trunc(range_lu / 7) WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' ELSE CAST(trunc(range_lu / 7) AS INT) || ' channels' END AS channels, {ADVICE} AS advice, 's' || series_id || '-LUFS-' || CAST(round(abs(integrated)) AS INT) || '-processed.flac' AS name FROM m",
    "limiter_plan": "SELECT series_id, round(gain_db, 6) AS gain_db, needed, needed AND free < -24 AS limit_clamped, round(greatest(0, -24 - free), 6) AS pre_gain_db, round(CASE WHEN NOT needed THEN 0 ELSE greatest(free, -24) END, 6) AS ceiling_db FROM lim",
    "linear_target": "SELECT series_id, round(inner_peak, 6) AS inner_peak_db, true AS linear, -16.0::DOUBLE AS target_lufs, round(gain_db, 6) AS offset_db, round(greatest(-9, least(0, inner_peak)), 6) AS emitted_peak_db, -1.9::DOUBLE AS brickwall_db FROM lim",
    "normalisation_result": "SELECT series_id, CASE WHEN integrated < -70 THEN 'silent' ELSE 'ok' END AS status, round(integrated + range_lu / 25 + 16, 6) AS deviation_lu, integrated >= -70 AND abs(integrated + range_lu / 25 + 16) <= 0.5 AS within_target, NOT has_bands AS varied FROM m",
    "recording_score": f"SELECT series_id, score, CASE WHEN score >= 90 THEN 5 WHEN score >= 75 THEN 4 WHEN score >= 60 THEN 3 WHEN score >= 40 THEN 2 ELSE 1 END AS stars, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Great' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' ELSE 'Poor' END AS label FROM (SELECT series_id, round(100 * (0.5 * CASE WHEN has_speech THEN 0.7 * {ramp('(speech_rms - floor)', 45, 16)} + 0.3 * {ramp('floor', -75, -45)} ELSE {ramp('floor', -75, -45)} END + 0.3 * {ramp('peak', -6, -1)} + 0.2 * (0.6 * {ramp('greatest(0, -23 - integrated)', 6, 18)} + 0.4 * {ramp('range_lu', 13, 22)})), 6) AS score FROM m)",
    "quality_score": f"SELECT series_id, round(100 * (0.5 * {ramp('abs(integrated + 16)', 0.5, 3)} + 0.3 * {ramp('CASE WHEN has_bands THEN peak ELSE 0 END', -1, 0)} + 0.2 * CASE WHEN has_speech THEN {ramp('floor', -75, -50)} ELSE 0 END), 6) AS score FROM m",
    "gain_advice": "SELECT series_id, CASE WHEN peak >= 0 THEN 'clipping' WHEN peak > -1 THEN 'hot' WHEN peak < -12 THEN 'quiet' ELSE 'fine' END AS kind, CASE WHEN peak > -1 OR peak < -12 THEN round(-6 - peak) ELSE 0 END AS delta_db FROM m",
    "image_names": "SELECT CAST(series_id AS VARCHAR) AS series_id, kind, stage, series_id || '.spectrogram-' || kind || '-' || stage || '.png' AS name FROM m, (VALUES ('whole'), ('roomtone'), ('speech')) AS k(kind), (VALUES ('input'), ('filtered'), ('final')) AS t(stage) WHERE kind = 'whole' OR (kind = 'roomtone' AND has_bands) OR (kind = 'speech' AND has_speech)",
}.items()}
_CENTRES = ", ".join(f"({i}, {c}.0::DOUBLE)" for i, c in enumerate(C.BAND_CENTRES_HZ))
ORACLE_SQL["band_edges"] = f"SELECT band, centre_hz, round(coalesce(sqrt(lag(centre_hz) OVER w * centre_hz), centre_hz / sqrt(lead(centre_hz) OVER w / centre_hz)), 6) AS low_hz, round(coalesce(sqrt(centre_hz * lead(centre_hz) OVER w), centre_hz * sqrt(centre_hz / lag(centre_hz) OVER w)), 6) AS high_hz FROM (VALUES {_CENTRES}) AS c(band, centre_hz) WINDOW w AS (ORDER BY band)"

_SIGNAL = "WITH sig AS (SELECT CAST(vec_id // 50 AS VARCHAR) AS series_id, (vec_id % 50) * 64 + k AS i, round(CAST(embedding[k + 1] AS DOUBLE) / 4, 6) AS x FROM embeddings, range(64) AS t(k) WHERE len(embedding) = 64)"
_DB = "CASE WHEN {0} > 0 THEN round(20 * log10({0}) + 3e-8, 6) WHEN {0} IS NOT NULL THEN CAST('-inf' AS DOUBLE) END"
_R = "round({0} + 3e-8, 6)"
ORACLE_SQL["level_statistics"] = f"""{_SIGNAL},
w AS (SELECT series_id, i // 160 AS k, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM sig GROUP BY ALL),
p AS (SELECT series_id, min(rms) AS trough, max(rms) AS loudest, min(peak) AS quietest FROM w GROUP BY 1),
s AS (SELECT series_id, count(*) AS n, avg(x) AS dc, min(x) AS low, max(x) AS high, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, min(abs(x)) FILTER (x <> 0) AS least FROM sig GROUP BY 1),
l AS (SELECT series_id, x, lag(x) OVER (PARTITION BY series_id ORDER BY i) AS b FROM sig),
d AS (SELECT series_id, min(abs(x - b)) AS dmin, max(abs(x - b)) AS dmax, avg(abs(x - b)) AS dmean, sqrt(avg((x - b) * (x - b))) AS drms, count(*) FILTER (sign(x) * sign(b) < 0) AS zc FROM l WHERE b IS NOT NULL GROUP BY 1),
e AS (SELECT sig.series_id, x, i - row_number() OVER (PARTITION BY sig.series_id, x ORDER BY i) AS run FROM sig JOIN s USING (series_id) WHERE x = low OR x = high),
f AS (SELECT series_id, sum(n * n) / sum(n) AS flat FROM (SELECT series_id, x, run, count(*) AS n FROM e GROUP BY ALL) GROUP BY 1)
SELECT series_id, n AS samples, {_R.format('dc')} AS dc_offset, {_R.format('low')} AS min_level, {_R.format('high')} AS max_level, {_R.format('dmin')} AS min_difference, {_R.format('dmax')} AS max_difference, {_R.format('dmean')} AS mean_difference, {_R.format('drms')} AS rms_difference,
{_DB.format('peak')} AS peak_db, {_DB.format('rms')} AS rms_db, {_DB.format('trough')} AS rms_trough_db, {_DB.format('loudest')} AS rms_peak_db, {_DB.format('(peak / rms)')} AS crest_db, {_DB.format('(2 * peak / least)')} AS dynamic_range_db, {_DB.format('quietest')} AS noise_floor_db, {_DB.format('flat')} AS flat_factor_db,
coalesce(zc, 0) AS zero_crossings, {_R.format('coalesce(zc, 0) / n')} AS zero_crossing_rate FROM s JOIN p USING (series_id) JOIN f USING (series_id) LEFT JOIN d USING (series_id)"""
_CURVE = f"""{_SIGNAL},
em AS (SELECT series_id, i // 64 AS block, avg(x * x) AS z FROM sig GROUP BY ALL),
en AS (SELECT series_id, block, z * pow(10.0, -(block % 9)) AS z FROM em),
cu AS (SELECT series_id, block, CASE WHEN block >= 3 THEN avg(z) OVER (o ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS mz, CASE WHEN block >= 29 THEN avg(z) OVER (o ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS sz FROM en WINDOW o AS (PARTITION BY series_id ORDER BY block)),
lo AS (SELECT *, -0.691 + 10 * log10(mz) AS m, -0.691 + 10 * log10(sz) AS s FROM cu)"""
ORACLE_SQL["loudness_curve"] = f"{_CURVE} SELECT series_id, block, {_R.format('m')} AS momentary, {_R.format('s')} AS short_term FROM lo"
ORACLE_SQL["programme_loudness"] = f"""{_CURVE},
mg AS (SELECT series_id, -0.691 + 10 * log10(avg(mz)) - 10 AS g FROM lo WHERE m >= -70 GROUP BY 1),
sg AS (SELECT series_id, -0.691 + 10 * log10(avg(sz)) - 20 AS g FROM lo WHERE s >= -70 GROUP BY 1),
it AS (SELECT series_id, -0.691 + 10 * log10(avg(mz)) AS integrated FROM lo JOIN mg USING (series_id) WHERE m >= -70 AND m >= g GROUP BY 1),
sv AS (SELECT series_id, list_sort(list(floor(s * 100) / 100)) AS v FROM lo JOIN sg USING (series_id) WHERE s >= -70 AND s >= g GROUP BY 1),
rg AS (SELECT series_id, v[CAST(floor((len(v) - 1) * 0.10 + 0.5) AS BIGINT) + 1] AS a, v[CAST(floor((len(v) - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS b FROM sv),
mx AS (SELECT series_id, max(m) AS mm, max(s) AS ms FROM lo GROUP BY 1)
SELECT series_id, {_R.format('integrated')} AS integrated, {_R.format('a')} AS range_low, {_R.format('b')} AS range_high, {_R.format('(b - a)')} AS loudness_range, {_R.format('mm')} AS max_momentary, {_R.format('ms')} AS max_short_term FROM mx LEFT JOIN it USING (series_id) LEFT JOIN rg USING (series_id)"""
