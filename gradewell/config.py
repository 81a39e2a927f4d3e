"""Fixed values that must equal the reference's for right results.

FIXED VALUES (reference constants, stated plainly, in natural order):
  * six essay grade names: cohesion, syntax, vocabulary, phraseology, grammar, conventions
  * constant grade written into a generated submission template: 3.0
  * seeds used for fold assignment: 1979 and 2022 (fine-tuning), 42 (some regressors)
  * number of folds: 4 (fine-tuning and most regressors), 25 (one regressor run)
  * Smooth-L1 switch point: |d| < 1 -> 0.5*d*d, else |d| - 0.5
  * root-squared-error loss epsilon: 1e-9
  * mean-pool mask clamp: 1e-9; max-pool fill: -1e4; min-pool fill: 1e-4
  * vector normalisation clamp: 1e-12
  * grade squashing: 4 * sigmoid(x) + 1  (bounds grades to 1..5)
  * boosted-tree patience: 500 rounds; round cap 6000; checkpoint check every 10 rounds
  * every-n-steps report: 20 steps
"""

from __future__ import annotations

REFERENCE_TARGETS = ("cohesion", "syntax", "vocabulary", "phraseology", "grammar", "conventions")
TEMPLATE_GRADE = 3.0
SEEDS = (1979, 2022)
DEFAULT_SEED = 2022
N_FOLDS = 4

SMOOTH_L1_BETA = 1.0
ROOT_SE_EPS = 1e-9
MEAN_POOL_CLAMP = 1e-9
MAX_POOL_FILL = -1e4
MIN_POOL_FILL = 1e-4
NORMALISE_CLAMP = 1e-12
GRADE_SCALE = 4.0
GRADE_SHIFT = 1.0

GBT_PATIENCE = 500
GBT_MAX_ROUNDS = 6000
CHECK_EVERY = 10
REPORT_EVERY = 20

# Mapping of the driver tables onto the reference's data model (our choice):
# labelled essays = labels JOIN documents, the two grades are quality and toxic.
DRIVER_TARGETS = ("quality", "toxic")
