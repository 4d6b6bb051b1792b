"""Parameters of the measurement pipeline. Fixed values, in decibels, hertz, seconds or shares as their names say."""

FRAME_HOP_S = 0.25
SILENCE_DB = -120.0
FLOORED_DB = -115.0
BIN_WIDTH_DB = 1.0
FLOOR_PERCENTILE = 10.0
VOICED_PERCENTILE = 10.0
NOISE_PERCENTILE = 95.0
CLAMP_PERCENTILE = 75.0
GAP_PERCENTILE = 75.0
HYSTERESIS_SHARE = 0.25
HYSTERESIS_FALLBACK_DB = 1.0
NOISE_MARGIN_DB = 2.0
VOICE_ACTIVATED_SHARE = 0.20
VETO_CENTROID_HZ = (200.0, 6000.0)
VETO_ENTROPY = 0.70

# Durations in hops of FRAME_HOP_S: least speech of a run, gap tolerance, quiet window, speech window.
RUN_HOPS = 40
GAP_HOPS = (8, 40)
QUIET_WINDOW_HOPS = (40, 32)
SPEECH_WINDOW_HOPS = (240, 120)

SEED_DECAY_DB = 6.0
SEED_WEIGHTS = (0.6, 0.4)
SEED_LEAST_INTERVALS = 10
SEED_TOP = 5
SEED_LEAST_COUNT = 8
SEED_HEADROOM_DB = 1.0

VOICED_KURTOSIS = 4.5
VOICING_FULL = 0.6
ROLLOFF_HZ = (2500.0, 4000.0, 8000.0, 10000.0)
FLUX_STEPS = ((0.004, 1.0), (0.010, 0.7), (0.020, 0.4), (0.030, 0.2))
WINDOW_WEIGHTS = {"kurtosis": 0.15, "flatness": 0.10, "centroid": 0.10, "consistency": 0.10, "rms": 0.10, "voicing": 0.15, "rolloff": 0.15, "flux": 0.15}
CANDIDATE_WEIGHTS = (0.6, 0.4, 0.02)
CANDIDATE_SNR_DB = (20.0, 40.0)
CANDIDATE_FULL_S = 30.0
CANDIDATE_VARIANCE_CAP = 25.0
CANDIDATE_VIABLE = 0.3

TIER_LUFS = (-20.0, -30.0)
TIER_OFFSET_DB = (18.0, 12.0, 8.0)
TIER_HEADROOM_DB = (40.0, 25.0, 15.0)
RMS_FLOOR_OFFSET_DB = 15.0
ROOM_TONE_S = (8, 18)
NOISE_FLOOR_DB = (-90.0, -30.0)

BAND_CENTRES_HZ = (80, 125, 195, 290, 440, 660, 1000, 1500, 2250, 3350, 5000, 7500, 11200, 16000, 24000)
BANDS_LEAST_FINITE = 10

TARGET_LUFS, TARGET_PEAK_DB, TARGET_RANGE_LU = -16.0, -1.0, 20.0
TARGET_TOLERANCE_LU = 0.5
LIMITER_MIN_DB = -24.0
BRICKWALL_HEADROOM_DB = 0.9
PEAK_CUSHION_DB = 0.2
LINEAR_SAFETY_DB = 0.1
PEAK_OPTION_DB = (-9.0, 0.0)

STARS = ((90, 5, "Excellent"), (75, 4, "Great"), (60, 3, "Good"), (40, 2, "Fair"), (0, 1, "Poor"))
