"""Parameters whose values must equal the reference's for matching results.

Operators take every one of these as an argument; these are the defaults.
"""

# Positional work.
TRAIN_FRACTION = 0.8          # first floor(0.8·n) rows after cleaning are train
PAGE_SIZE = 50                # rows per page
PREVIEW_ROWS = 10             # rows in a preview / held-out prediction sample
RANDOM_SAMPLE_ROWS = 10       # rows in the random sample of a table
PAIR_SAMPLE_ROWS = 2000       # rows sampled for the pair plot
SAMPLE_SEED = 42              # seed of the sampled rows
SCATTER_POINTS = 200          # evenly spaced test points of the regression scatter
LINE_POINTS = 30              # points of the fitted regression line
PROB_SAMPLE_PER_CLASS = 300   # predicted probabilities kept per actual class

# Statistics and chart data.
IQR_FENCE = 1.5               # outlier fences at q1 − 1.5·IQR and q3 + 1.5·IQR
CURVE_BINS = 15               # equal-width bins of the class-rate curve
CUT_WIDENING = 0.001          # low edge widened by this fraction of the range
KDE_GRID = 200                # grid points of a density curve
KDE_BINS = 16                 # bins per bandwidth of a binned density curve
GRID_SIZE = 200               # cells per axis of the decision grid
GRID_PAD_X = 0.5              # padding of the first grid feature's range
GRID_PAD_Y = 5.0              # padding of the second grid feature's range

# Models.
GD_ALPHA = 0.01               # gradient-descent learning rate
GD_EPOCHS = 1000              # gradient-descent epochs
GD_COST_STRIDE = 20           # every 20th cost is reported
SIG_EPS = 1e-9                # added to every fitted standard deviation
RIDGE_ALPHA = 1.0
LASSO_ALPHA = 0.1
ENET_ALPHA = 0.1
ENET_L1_RATIO = 0.5
LOGISTIC_C = 1.0              # inverse L2 strength of the logistic models
Z_CLIP = 500.0                # linear score clipped to ±500 before the sigmoid
CLASS_THRESHOLD = 0.5         # predicted class 1 when the probability reaches 0.5

# Texts of result columns.
RANGE_TEXT = "%s → %s"        # smallest and largest fitted value
MAPPING_TEXT = "{} → {}"      # an ordinal level and its code
MAPPING_SEPARATOR = " | "
DUMMY_TEXT = "{}_..."         # names of a category's dummy columns
