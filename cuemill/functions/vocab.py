"""Fixed vocabularies of the subtitle rules."""

from __future__ import annotations

# Limits of a readable cue.
MAX_CHARS = 40
MAX_CUE_MS = 7000
MIN_CUE_MS = 800
MAX_MERGE_GAP_MS, MIN_MERGE_GAP_MS = 350, -50
PHRASE_OVERFLOW = 12

# Reading speed in characters a second.
READING_SPEED = {"zh": 15, "ja": 10, "en": 17, "ko": 12}
DEFAULT_SPEED = 18
SPEED_LANGUAGES = ("zh", "ja", "en", "ko", "auto")

# Words that should not end a line, and phrases that should not be parted.
FUNCTION_WORDS = (
    "a an the this that these those to of in on at by for from with into onto over under after before during without about as than via and or but".split()
)
PROTECTED_PHRASES = ("a lot of", "day one update", "first things first", "for example", "in order to", "one of the", "right now", "up and running")

# Language code -> suffix that players read.
PLAYER_SUFFIX = {
    "zh": "chs", "zh-hant": "cht", "ja": "jpn", "en": "eng", "ko": "kor", "fr": "fre", "de": "ger",
    "es": "spa", "pt": "por", "it": "ita", "ru": "rus", "ar": "ara", "th": "tha", "vi": "vie",
}

# Language code -> a provider's code, by scheme; others are lower-cased. An empty code has a default.
PROVIDER_CODES = {
    "edge": {"auto": "auto-detect", "zh": "zh-Hans", "zh-cn": "zh-Hans", "zh-hans": "zh-Hans", "zh-tw": "zh-Hant", "zh-hant": "zh-Hant"},
    "gtx": {"zh": "zh-CN", "zh-cn": "zh-CN", "zh-hans": "zh-CN", "zh-tw": "zh-TW", "zh-hant": "zh-TW"},
}
PROVIDER_DEFAULT = {"edge": "auto", "gtx": "zh"}

# Stage -> start and end of its part of a job's progress.
STAGE_SPANS = {"extracting": (0.00, 0.12), "splitting": (0.12, 0.16), "loading_model": (0.16, 0.26), "transcribing": (0.26, 0.96), "writing": (0.96, 1.00)}

# HTTP states after which a request may be sent again.
TRANSIENT = (408, 429, 500, 502, 503, 504)

# Extensions of media files.
MEDIA_EXTENSIONS = ("mp4", "mkv", "mov", "avi", "flv", "wmv", "m4a", "mp3", "wav", "flac", "ogg", "opus", "aac", "wma")
#: Further ones that inputs may have.
MORE_MEDIA_EXTENSIONS = ("webm", "m4v", "ts")

# Share of a job's progress that recognition fills before translation.
ASR_CEILING = {"web": 0.75, "local": 0.85, "none": 1.0}
