"""Patterns, tables and limits whose exact content decides results."""

from __future__ import annotations

# Text predicates.
MATH_TAG = r"(?s)<math>.*?</math>"
EQUATION_LABEL = r"(?U)\(\d+(\.\d+)*[a-z]?\)"
LETTER_RUN = r"[A-Za-z\u00C0-\u024F\u0370-\u03FF\u0400-\u04FF\u0600-\u06FF\u0900-\u097F\u0E00-\u0E7F\u2E80-\u9FFF]{2,}"
BLANK_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Replacements in OCR text, in this order.
OCR_REPLACEMENTS = (
    ("ﬁ", "fi"),
    ("ﬂ", "fl"),
    ("ﬀ", "ff"),
    ("ﬃ", "ffi"),
    ("ﬄ", "ffl"),
    ("‘", "'"),
    ("’", "'"),
    ("“", '"'),
    ("”", '"'),
    ("–", "-"),
    ("—", "-"),
    ("−", "-"),
    (" ", " "),
    ("…", "..."),
)

# A leading block of a model's thoughts, in three strictnesses.
THINK = {"plain": r"(?s)^<think>.+?</think>", "lines": r"(?s)^<think>.+?\n*(</think>|\n)*(</think>)\n*", "gateway": r"(?sU)^\s*<think>.*?</think>"}

# Drawing operators: font, size, x, y, codes; and x, y, width, dx, dy.
TEXT_OP = "/%s %f Tf 1 0 0 1 %f %f Tm [<%s>] TJ "
LINE_OP = "ET q 1 0 0 1 %f %f cm [] 0 d 0 J %f w 0 0 m %f %f l S Q BT "

# Layout labels and their categories.
CATEGORIES = ("BYPASS", "FLOWING_TEXT", "IN_PLACE", "TABLE", "EQUATION")
DEFAULT_CATEGORY = "FLOWING_TEXT"
LABEL_CATEGORIES = {
    "Text": "FLOWING_TEXT",
    "List-item": "FLOWING_TEXT",
    "Footnote": "FLOWING_TEXT",
    "Handwriting": "FLOWING_TEXT",
    "Section-header": "IN_PLACE",
    "Page-header": "IN_PLACE",
    "Page-footer": "IN_PLACE",
    "Caption": "IN_PLACE",
    "Table-of-contents": "IN_PLACE",
    "Picture": "BYPASS",
    "Figure": "BYPASS",
    "Form": "BYPASS",
    "Table": "TABLE",
    "Formula": "EQUATION",
    "Text-inline-math": "EQUATION",
}
RAW_TEXT_CATEGORIES = ("FLOWING_TEXT", "IN_PLACE")
TOC_LABELS = ("Section-header", "Table-of-contents")
EQUATION_LATEX = "[EQUATION_PLACEHOLDER]"
RESERVED_REGIONS = ("abandon", "figure", "table", "isolate_formula", "formula_caption")

# Glyphs that belong to formulas.
FORMULA_FONT = r"^(CM[^R]|MS.M|XY|MT|BL|RM|EU|LA|RS|LINE|LCIRCLE|TeX-|rsfs|txsy|wasy|stmary|.*Mono|.*Code|.*Ital|.*Sym|.*Math)"
FORMULA_CHAR = r"^[\p{Lm}\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}Ͱ-Ͽ]"
MODIFIER_CHAR = r"^[\p{Lm}\p{Mn}\p{Sk}]"

# Line heights by target language, and language tables.
LINE_HEIGHTS = {"zh-cn": 1.4, "zh-tw": 1.4, "zh-hans": 1.4, "zh-hant": 1.4, "zh": 1.4, "ja": 1.1, "ko": 1.2, "en": 1.2, "ar": 1.0, "ru": 0.8, "uk": 0.8, "ta": 0.8}
DEFAULT_LINE_HEIGHT = 1.1
LANGUAGE_NAMES = {"zh": "Chinese", "zh-TW": "Chinese", "en": "English", "fr": "French", "de": "German", "ja": "Japanese", "ko": "Korean", "ru": "Russian", "es": "Spanish", "it": "Italian"}
PROVIDER_CODES = {"google": {"zh": "zh-CN"}, "bing": {"zh": "zh-Hans"}, "deepl": {"zh": "zh-Hans"}, "deeplx": {"zh": "zh-Hans"}, "azure": {"zh": "zh-Hans"}}
FONTS = {"zh-cn": "SourceHanSerifCN-Regular.ttf", "zh-hans": "SourceHanSerifCN-Regular.ttf", "zh": "SourceHanSerifCN-Regular.ttf", "zh-tw": "SourceHanSerifTW-Regular.ttf", "zh-hant": "SourceHanSerifTW-Regular.ttf", "ja": "SourceHanSerifJP-Regular.ttf", "ko": "SourceHanSerifKR-Regular.ttf"}
DEFAULT_FONT = "GoNotoKurrent-Regular.ttf"

# Limits.
CHUNK_BYTES, LENGTH_TOLERANCE, LENGTH_MIN_CHARS = 3000, 0.15, 20
TEXT_CAPS = {"google": 5000, "bing": 1000}
MIN_CONFIDENCE, OVERLAP, EDGE_TOLERANCE, DEGENERATE = 0.25, 0.5, 0.01, 0.1
TEXT_CHARS, TEXT_BLOCKS, IMAGE_COVERAGE, SAMPLED_PAGES = 100, 3, 0.5, 5
MAX_LINE_WIDTH, SUBSCRIPT, LINE_STEP = 5, 0.79, 0.05
DOMINANT_IMAGE = 0.8

# Services and the parameters that their cache keys have beside both languages and the model.
SERVICES = {
    "google": (),
    "bing": (),
    "deepl": (),
    "deeplx": (),
    "ollama": ("temperature",),
    "xinference": ("temperature",),
    "openai": ("temperature", "prompt", "think"),
    "azure-openai": ("temperature", "prompt"),
    "modelscope": ("temperature", "prompt", "think"),
    "zhipu": ("temperature", "prompt", "think"),
    "silicon": ("temperature", "prompt", "think"),
    "302ai": ("temperature", "prompt", "think"),
    "gemini": ("temperature", "prompt", "think"),
    "azure": (),
    "tencent": (),
    "anythingllm": (),
    "dify": (),
    "argos": (),
    "grok": ("temperature", "prompt", "think"),
    "groq": ("temperature", "prompt", "think"),
    "deepseek": ("temperature", "prompt", "think"),
    "openailiked": ("temperature", "prompt", "think"),
    "qwen-mt": ("temperature", "prompt", "think"),
}
UNCACHED_SERVICES = ("argos",)
RESULT_MARK = r'(?s)class="(?:t0|result-container)">(.*?)<'
