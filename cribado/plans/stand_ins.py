"""Stand-ins for model output.

There is no model offline, so responses and scores are derived from the documents. They
exercise the data work and say nothing about text quality. The SQL reads the same in Spark and
in DuckDB.
"""

from __future__ import annotations

import math

import numpy as np

RATING_TEMPLATE = (
    "Valore de 0 a 5 la utilidad escolar del texto.\n\n<EJEMPLO>\n\n"
    'Termine con "PUNTUACIÓN EDUCATIVA: <puntos>"'
)

# What a model would say about the text before its verdict: here the text's own beginning.
REMARK = "substr(coalesce(text, ''), 1, 200)"

RATING_RESPONSE = f"""CASE
  WHEN doc_id % 13 = 5 THEN {REMARK}
  WHEN doc_id % 13 = 6 THEN concat({REMARK}, 'PUNTUACIÓN EDUCATIVA: **4**')
  WHEN doc_id % 29 = 3 THEN concat({REMARK}, 'PUNTUACIÓN EDUCATIVA: .5')
  WHEN doc_id % 29 = 4 THEN 'PUNTUACIÓN EDUCATIVA: 12/5'
  ELSE concat({REMARK}, chr(10), 'PUNTUACIÓN EDUCATIVA: ',
    cast(cast(floor(((doc_id*7+n_chars) % 60)/10) AS int) AS string), '.',
    cast((doc_id*7+n_chars) % 10 AS string), ' ', {REMARK}) END"""

STORED_RESPONSE = """concat('Breve justificación.', chr(10), 'PUNTUACIÓN EDUCATIVA: ',
    cast(quality * 4 + toxic AS string))"""

RUN_RESPONSE = f"CASE WHEN doc_id % 17 = 2 THEN NULL ELSE {RATING_RESPONSE} END"
RUN_ERROR = "CASE WHEN doc_id % 17 = 2 THEN 'TimeoutError: stand-in' END"

SCORE = "((doc_id*31+n_chars) % 29 - 2) / cast(4 AS double)"

DATASET = "CASE WHEN source='src7' THEN 'src7-toxicity' ELSE source END"

# Words of the text: a plain one, one with any letters, and the text after its first letters.
PLAIN_WORD = "regexp_extract(coalesce(text, ''), '[a-z]{4,}', 0)"
ANY_WORD = "regexp_extract(coalesce(text, ''), '[a-zß-ÿ]{5,}', 0)"
PIECES = [f"substr(coalesce(text, ''), {start}, {length})" for start, length in ((1, 12), (13, 30), (50, 60))]

LABEL_RESPONSE = f"""CASE doc_id % 9
  WHEN 0 THEN concat('DOMINIO: Apicultura, ', {PLAIN_WORD}, chr(10), 'CASOS DE USO: Censo de colmenas, ', {ANY_WORD})
  WHEN 1 THEN concat('DOMINIO: Relojería', chr(10),
    'CASOS DE USO: Ajuste de péndulos, E-commerce, ', {PLAIN_WORD})
  WHEN 2 THEN concat('DOMINIO: Sin coincidencia', chr(10), 'CASOS DE USO: Sin coincidencia')
  WHEN 3 THEN concat('DOMINIO: Faros.', chr(10), 'CASOS DE USO: ', {ANY_WORD})
  WHEN 4 THEN concat({PIECES[2]}, 'DOMINIO: ', {ANY_WORD}, chr(10), 'CASOS DE USO: ', {PIECES[1]})
  WHEN 5 THEN concat('DOMINIO: ', {PIECES[0]}, chr(10), 'CASOS DE USO: Mapas de mareas, Mapas de mareas')
  WHEN 6 THEN concat('DOMINIO: Faros, Apicultura', chr(10), 'CASOS DE USO: Sin coincidencia')
  WHEN 7 THEN concat('DOMINIO: Encuadernación, ', {ANY_WORD}, chr(10), 'CASOS DE USO: ', {PIECES[1]}, ', ', {PLAIN_WORD})
  ELSE {PIECES[2]} END"""

MIXED_PATH = "concat(source, CASE WHEN doc_id % 2 = 0 THEN '-toxicity' ELSE '' END)"
TAXONOMY = [
    ("domain", "Apicultura"),
    ("domain", "Faros"),
    ("domain", "Vidrieras"),
    ("use_case", "Censo de colmenas"),
    ("use_case", "Mapas de mareas"),
    ("use_case", "Calendario de riego"),
]

SHARD_PATH = "concat('/corpora/', replace(source, 'src', 'src_'), '_', lang, '/data-', cast(doc_id % 4 AS string), '.arrow')"
MODEL_PATH = "models/Demo-70B_v1.5-Instruct"

# Fixed weights for the head that is checked in SQL.
HEAD_WEIGHTS = [((i * 7) % 11 - 5) / 10 for i in range(64)]
HEAD_INTERCEPT = 2.5

# Stand-in for an encoder: length and letter shares, in SQL and in numpy.
LETTERS = "aeosntw"
TEXT_FEATURES = ["ln(1 + length(text)) / 8"] + [
    f"(length(text) - length(replace(text, '{c}', ''))) / cast(greatest(length(text), 1) AS double)" for c in LETTERS
]

# A short training, to be checked step by step.
STEPS, EVALUATE_EVERY, RATE = 24, 6, 0.05

RIDGE_GRID = (0.0, 0.01, 0.1, 1.0)

ENCODER_TOKENS = 512
PROMPT_TAIL_TOKENS = 2_000
THRESHOLD = 3


def stub_encoder():
    """`make_predict_fn` with the features above as 32-bit numbers. A stub, not a trained encoder."""

    def predict(texts):
        rows = [[math.log(1 + len(t)) / 8] + [t.count(c) / max(len(t), 1) for c in LETTERS] for t in texts]
        return np.array(rows, dtype="float32")

    return predict


def stub_judge():
    """Predictor factory: rates a prompt by its length. A stub, not a judge of quality."""

    def predict(prompts: list[str]) -> list[str]:
        return [f"Juez de prueba.\nPUNTUACIÓN EDUCATIVA: {min(len(p) // 600, 5)}" for p in prompts]

    return predict
