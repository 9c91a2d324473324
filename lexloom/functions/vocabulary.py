"""Controlled vocabularies and mapping tables. Records and model classes depend on them and their order."""

ATOM_TYPES = ["NOUN_LIKE", "PROPER_LIKE", "VERB_STEM", "ADJECTIVE", "ADVERB", "PARTICLE", "AUXILIARY", "COPULA", "PREFIX_SUFFIX", "NUMBER", "PUNCT_SYMBOL", "OTHER"]
PARTICLE_FUNCTIONS = ["TOPIC", "SUBJECT_CASE", "OBJECT", "LOCATION", "DIRECTION", "TIME", "COMITATIVE", "QUOTATIVE", "GENITIVE", "CONNECTIVE", "OTHER", "UNKNOWN"]
INFLECTIONS = ["PAST", "NEGATIVE", "POLITE", "TE_FORM", "CONDITIONAL", "VOLITIONAL", "PASSIVE", "CAUSATIVE", "POTENTIAL", "ASPECTUAL"]
BUNSETSU_ROLES = ["TOPIC", "CASED_NOMINAL", "PREDICATE", "MODIFIER", "CONNECTIVE", "ADVERBIAL", "PUNCT", "OTHER", "UNKNOWN"]
#: Boundary levels, fine to coarse.
LEVELS = ["a", "b", "bunsetsu", "clause", "sentence"]
SCRIPTS = ["HIRAGANA", "KATAKANA", "KANJI", "LATIN", "DIGIT", "PUNCT", "SYMBOL", "WHITESPACE", "OTHER"]
PUNCT_CLASSES = ["NONE", "SENTENCE", "OPEN", "CLOSE", "COMMA"]
DIGIT_CLASSES = ["NONE", "ASCII", "FULLWIDTH", "OTHER"]
INFLECTED = ["VERB_STEM", "AUXILIARY", "COPULA", "ADJECTIVE"]
SCHEMA_VERSION, MAPPING_VERSION = "jpu.phase1.v1", "v1"

# Sentence enders and what closes a sentence after them.
ENDERS = "。！？!?．"
CLOSERS = "」』）】〕〉》〗〙〛”)’\"'"
# Punctuation classes, small kana, prolonged and iteration marks.
PUNCT_SETS = {"SENTENCE": "。！？!?．", "OPEN": "「『（【〔〈《", "CLOSE": "」』）】〕〉》", "COMMA": "、，,"}
SMALL_KANA = "ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮ"
PROLONGED = "ーｰ"
ITERATION = "々〆ヽヾゝゞー"

# Morphological analyser part of speech to atom type.
POS_ATOM = {
    "名詞": "NOUN_LIKE", "代名詞": "NOUN_LIKE", "動詞": "VERB_STEM", "形容詞": "ADJECTIVE", "形状詞": "ADJECTIVE", "副詞": "ADVERB",
    "助詞": "PARTICLE", "助動詞": "AUXILIARY", "接頭辞": "PREFIX_SUFFIX", "接尾辞": "PREFIX_SUFFIX", "連体詞": "OTHER", "接続詞": "OTHER",
    "感動詞": "OTHER", "補助記号": "PUNCT_SYMBOL", "記号": "PUNCT_SYMBOL", "空白": "OTHER", "UNK": "OTHER",
}
NOUN_DETAIL = {"固有名詞": "PROPER_LIKE", "数詞": "NUMBER"}
COPULA_TYPES = ["助動詞-ダ", "助動詞-デス"]
# Particle surface, particle detail.
PARTICLE_SURFACE = {
    "は": "TOPIC", "も": "TOPIC", "が": "SUBJECT_CASE", "を": "OBJECT", "へ": "DIRECTION", "まで": "DIRECTION", "と": "COMITATIVE",
    "より": "OTHER", "の": "GENITIVE", "って": "QUOTATIVE", "て": "CONNECTIVE", "で": "CONNECTIVE", "ながら": "CONNECTIVE",
}
PARTICLE_DETAIL = {"係助詞": "TOPIC", "格助詞": "UNKNOWN", "接続助詞": "CONNECTIVE", "終助詞": "OTHER", "副助詞": "OTHER", "準体助詞": "OTHER"}
# Inflection flags by normalized form, inflection form and surface.
INFLECTION_NORMALIZED = {
    "ない": ["NEGATIVE"], "ぬ": ["NEGATIVE"], "ん": ["NEGATIVE"], "た": ["PAST"], "だ": ["PAST"], "ます": ["POLITE"],
    "れる": ["PASSIVE"], "られる": ["PASSIVE"], "せる": ["CAUSATIVE"], "させる": ["CAUSATIVE"], "たい": ["ASPECTUAL"], "いる": ["ASPECTUAL"],
}
INFLECTION_FORM = {
    "仮定形": ["CONDITIONAL"], "仮定形-一般": ["CONDITIONAL"], "仮定形-融合": ["CONDITIONAL"], "意志推量形": ["VOLITIONAL"],
    "連用形-促音便": ["TE_FORM"], "連用形-イ音便": ["TE_FORM"], "連用形-撥音便": ["TE_FORM"], "連用形-ウ音便": ["TE_FORM"],
}
INFLECTION_SURFACE = {
    "なかっ": ["NEGATIVE"], "なかった": ["NEGATIVE", "PAST"], "ました": ["POLITE", "PAST"], "ません": ["POLITE", "NEGATIVE"],
    "ませんでした": ["POLITE", "NEGATIVE", "PAST"],
}
# Dependency to bunsetsu role.
DEPENDENCY_ROLE = {
    "punct": "PUNCT", "root": "PREDICATE", "advcl": "CONNECTIVE", "acl": "MODIFIER", "advmod": "ADVERBIAL", "obl": "CASED_NOMINAL",
    "nsubj": "CASED_NOMINAL", "obj": "CASED_NOMINAL", "iobj": "CASED_NOMINAL", "nmod": "MODIFIER", "compound": "MODIFIER", "cc": "CONNECTIVE",
    "conj": "CONNECTIVE",
}
# Universal part of speech and particle surfaces of CoNLL-U gold.
UPOS_ATOM = {
    "NOUN": "NOUN_LIKE", "PRON": "NOUN_LIKE", "PROPN": "PROPER_LIKE", "VERB": "VERB_STEM", "ADJ": "ADJECTIVE", "ADV": "ADVERB", "ADP": "PARTICLE",
    "SCONJ": "PARTICLE", "CCONJ": "PARTICLE", "PART": "PARTICLE", "AUX": "AUXILIARY", "NUM": "NUMBER", "PUNCT": "PUNCT_SYMBOL", "SYM": "PUNCT_SYMBOL",
}
UD_FUNCTION = {"は": "TOPIC", "が": "SUBJECT_CASE", "を": "OBJECT", "へ": "DIRECTION", "の": "GENITIVE", "て": "CONNECTIVE", "で": "UNKNOWN", "に": "UNKNOWN", "と": "UNKNOWN"}
# Part of speech and particle surfaces of KNP gold.
KNP_ATOM = {
    "名詞": "NOUN_LIKE", "指示詞": "NOUN_LIKE", "動詞": "VERB_STEM", "形容詞": "ADJECTIVE", "副詞": "ADVERB", "助詞": "PARTICLE", "助動詞": "AUXILIARY",
    "判定詞": "COPULA", "接頭辞": "PREFIX_SUFFIX", "接尾辞": "PREFIX_SUFFIX", "特殊": "PUNCT_SYMBOL", "未定義語": "OTHER", "連体詞": "OTHER",
    "接続詞": "OTHER", "感動詞": "OTHER",
}
KNP_FUNCTION = {
    "は": "TOPIC", "が": "SUBJECT_CASE", "を": "OBJECT", "へ": "DIRECTION", "から": "DIRECTION", "まで": "DIRECTION", "と": "COMITATIVE",
    "の": "GENITIVE", "て": "CONNECTIVE", "で": "UNKNOWN", "に": "UNKNOWN",
}
# Endings and flags of two conjugations.
PARADIGMS = {
    "godan_k": {
        "dictionary": ("く", []), "past": ("いた", ["PAST"]), "negative": ("かない", ["NEGATIVE"]), "negative_past": ("かなかった", ["NEGATIVE", "PAST"]),
        "conditional": ("けば", ["CONDITIONAL"]), "volitional": ("こう", ["VOLITIONAL"]), "causative": ("かせる", ["CAUSATIVE"]), "passive": ("かれる", ["PASSIVE"]),
        "causative_passive": ("かせられる", ["CAUSATIVE", "PASSIVE"]),
    },
    "ichidan": {
        "dictionary": ("る", []), "past": ("た", ["PAST"]), "negative": ("ない", ["NEGATIVE"]), "negative_past": ("なかった", ["NEGATIVE", "PAST"]),
        "conditional": ("れば", ["CONDITIONAL"]), "volitional": ("よう", ["VOLITIONAL"]), "causative": ("させる", ["CAUSATIVE"]), "passive": ("られる", ["PASSIVE"]),
        "causative_passive": ("させられる", ["CAUSATIVE", "PASSIVE"]),
    },
}
SYNTHETIC_SOURCE, SYNTHETIC_FRACTION = "synthetic-morphology-v1", 0.15
# Model sizes (codepoint buckets, width; bigram buckets, width; hidden) and dilations.
MODEL_SIZES = {"50k": (4096, 6, 4096, 3, 48), "100k": (8192, 6, 8192, 3, 56), "150k": (8192, 8, 8192, 4, 64), "250k": (8192, 16, 8192, 8, 72)}
DILATIONS = (1, 2, 4, 8, 16)
HEADS = {"boundaries": 5, "atom": 12, "function": 12, "inflection": 10, "role": 9}
# Weights of the losses.
LOSS_WEIGHTS = {"boundaries": 1.0, "atom": 0.7, "inflection": 0.6, "function": 0.4, "role": 0.4}
