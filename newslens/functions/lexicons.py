"""Fixed word lists and lookup tables.

The stop-word list is Spark's published Spanish default (the Snowball list that
``StopWordsRemover.loadDefaultStopWords("spanish")`` returns); it is read from
the MLlib jar so no copy is kept here. The other tables are small stand-ins for
model output (part-of-speech tagger, entity gazetteer, sentiment lexicon); they
are data, so users can pass their own.
"""

from __future__ import annotations

import functools
import glob
import os
import string
import zipfile


@functools.lru_cache(maxsize=None)
def spanish_stop_words() -> tuple[str, ...]:
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = "org/apache/spark/ml/feature/stopwords/spanish.txt"
            if name in z.namelist():
                words = z.read(name).decode("utf-8").split("\n")
                return tuple(w.strip() for w in words if w.strip())
    from pyspark.ml.feature import StopWordsRemover  # needs an active JVM

    return tuple(StopWordsRemover.loadDefaultStopWords("spanish"))


# --- fixed values -----------------------------------------------------------
# Entity-normalisation punctuation: ASCII punctuation plus curly quotes.
ENTITY_PUNCT = string.punctuation + "“”‘’"
# Entity types kept for clustering.
ENTITY_TYPES = ("PER", "ORG", "LOC", "MISC", "DATE")
# Edge weights and threshold of the event graph.
EDGE_ALPHA, EDGE_BETA, EDGE_GAMMA, EDGE_MIN_WEIGHT = 0.5, 0.4, 0.1, 0.3
# Jaccard denominator guard.
JACCARD_EPS = 1e-6
# Neighbours per document, PCA components, community split size and Ward distance.
KNN_K, PCA_K, SPLIT_MIN_SIZE, WARD_DISTANCE = 30, 100, 20, 1.5
# Topic vocabulary cap, topics kept, topics used for the tfidf cells, entity top-k.
TOPIC_VOCAB_CAP, TOPICS_TOP, TOPIC_CELLS, ENTITY_TOP = 100, 5, 3, 5
# Entity text is truncated to this many characters before tagging.
ENTITY_TRUNCATE = 512
# Orientation thresholds on the bias score.
ORIENT_HIGH, ORIENT_LOW = 0.5, -0.5
# Mixed balancing shares of the majority count.
MIX_MAJ_SHARE, MIX_MIN_SHARE = 0.7, 0.6
# Folds and default seed.
N_FOLDS, SEED = 3, 42
# --- end fixed values -------------------------------------------------------

# Default closed-class part-of-speech lookup (Spanish function words), used by
# the rule tagger; open-class words default to X, numbers to NUM, punctuation
# to PUNCT.
POS_LOOKUP = (
    ("el", "DET"), ("la", "DET"), ("los", "DET"), ("las", "DET"), ("un", "DET"),
    ("una", "DET"), ("unos", "DET"), ("unas", "DET"), ("este", "DET"), ("esta", "DET"),
    ("de", "ADP"), ("en", "ADP"), ("a", "ADP"), ("por", "ADP"), ("para", "ADP"),
    ("con", "ADP"), ("sin", "ADP"), ("sobre", "ADP"), ("entre", "ADP"), ("hasta", "ADP"),
    ("y", "CCONJ"), ("o", "CCONJ"), ("pero", "CCONJ"), ("ni", "CCONJ"),
    ("que", "SCONJ"), ("porque", "SCONJ"), ("si", "SCONJ"), ("cuando", "SCONJ"),
    ("yo", "PRON"), ("él", "PRON"), ("ella", "PRON"), ("nosotros", "PRON"), ("ellos", "PRON"),
    ("se", "PRON"), ("lo", "PRON"), ("le", "PRON"),
    ("es", "AUX"), ("son", "AUX"), ("fue", "AUX"), ("ha", "AUX"), ("han", "AUX"),
    ("no", "ADV"), ("muy", "ADV"), ("más", "ADV"), ("ya", "ADV"), ("también", "ADV"),
    ("the", "DET"), ("and", "CCONJ"), ("of", "ADP"), ("to", "ADP"), ("is", "AUX"),
    ("le", "DET"), ("les", "DET"), ("du", "ADP"), ("et", "CCONJ"), ("der", "DET"),
    ("die", "DET"), ("und", "CCONJ"),
)

# Default entity gazetteer: lower-cased surface form -> type. Anything else a
# capitalised run matches is MISC.
GAZETTEER = (
    ("madrid", "LOC"), ("barcelona", "LOC"), ("españa", "LOC"), ("europa", "LOC"),
    ("paris", "LOC"), ("berlin", "LOC"), ("london", "LOC"),
    ("gobierno", "ORG"), ("congreso", "ORG"), ("senado", "ORG"), ("psoe", "ORG"), ("pp", "ORG"),
    ("vox", "ORG"), ("sumar", "ORG"), ("ue", "ORG"),
    ("sánchez", "PER"), ("feijóo", "PER"), ("abascal", "PER"), ("díaz", "PER"),
    ("lunes", "DATE"), ("martes", "DATE"), ("miércoles", "DATE"), ("jueves", "DATE"),
    ("viernes", "DATE"), ("enero", "DATE"), ("febrero", "DATE"), ("marzo", "DATE"),
)

# Default sentiment lexicon: lower-cased word -> polarity in [-1, 1].
SENTIMENT_LEXICON = (
    ("bueno", 1.0), ("buena", 1.0), ("excelente", 1.0), ("mejor", 0.6), ("bien", 0.6),
    ("malo", -1.0), ("mala", -1.0), ("peor", -0.6), ("mal", -0.6), ("terrible", -1.0),
    ("good", 1.0), ("great", 1.0), ("best", 0.6), ("bad", -1.0), ("worst", -1.0),
    ("bon", 1.0), ("bonne", 1.0), ("mauvais", -1.0), ("gut", 1.0), ("schlecht", -1.0),
    ("feliz", 0.8), ("triste", -0.8), ("happy", 0.8), ("sad", -0.8), ("crisis", -0.6),
    ("éxito", 0.8), ("fracaso", -0.8), ("success", 0.8), ("failure", -0.8),
)
