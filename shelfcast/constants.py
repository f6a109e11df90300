"""Business constants and default thresholds.

Fixed values: these must equal the planning rules being reproduced, because results depend on them.
"""

# Inventory analysis
DSI_SENTINEL = 999.0
ABC_A_PCT = 80.0
ABC_B_PCT = 95.0
RISK_WEIGHT_LEAD = 0.4
RISK_WEIGHT_COVERAGE = 0.4
RISK_WEIGHT_DEMAND = 0.2
RISK_BINS = (0.0, 0.3, 0.5, 0.7, 1.0)
RISK_LABELS = ("Low", "Medium", "High", "Critical")
STATUS_NORMAL = "Normal Stock"
STATUS_LOW = "Low Stock"
STATUS_OUT = "Out of Stock"

# Supply chain
ORDERING_COST = 50.0
HOLDING_RATE = 0.25
MONTE_CARLO_TRIALS = 5000

# Forecasting
FEATURE_LAGS = (1, 7, 14, 28)
NAIVE_WINDOW = 30
COLD_START_DAYS = 60
INTERMITTENT_SHARE = 0.5
SERVING_INTERMITTENT_SHARE = 0.3
SEASON_PERIOD = 7
EWM_LOOKBACK = 30
N_HARMONICS = 3

# Evaluation
CV_WINDOWS = 12
CV_STEP_DAYS = 30
CV_HORIZON = 14
CV_MIN_TRAIN_DAYS = 60
CONFORMAL_COVERAGE = 0.90
GATE_MAPE = 25.0
ROUTING_THRESHOLDS = (30, 40, 50, 60, 70, 90, 120)

# Drift
KS_P_THRESHOLD = 0.05
PSI_THRESHOLD = 0.1
PSI_SEVERE = 0.25
MAPE_ALERT_PCT = 20.0
RETRAIN_DAYS = 7

# Capacity
PRODUCTION_LINES = 3
SHIFT_HOURS = 8.0
MAX_OVERTIME_HOURS = 4.0
CHANGEOVER_COST_PER_HOUR = 150.0
UTILIZATION_TARGET = 0.85
OUTSOURCE_UNIT_COST = 2.0

# Demand sensing
SOURCE_WEIGHTS = {"pos": 0.6, "social": 0.25, "weather": 0.15}
UNKNOWN_SOURCE_WEIGHT = 0.3
DECAY_HALF_LIFE_DAYS = 7
SPIKE_SIGMA = 2.5
SENSING_HORIZON_DAYS = 14
SIGNAL_BLEND = 0.3

# Sales and operations planning
SOP_HORIZON_DAYS = 90
SOP_BUCKET_DAYS = 7
SOP_TARGET_FILL = 0.95
SOP_STOCKOUT_PENALTY = 50.0
SOP_HOLDING_RATE = 0.25
SOP_SHORT_SUPPLY = 0.7
SOP_OPENING_SHARE = 0.3
# name, demand multiplier, capacity multiplier, supply reliability
SOP_SCENARIOS = (
    ("baseline", 1.0, 1.0, 0.95),
    ("optimistic", 1.2, 1.1, 0.98),
    ("conservative", 0.85, 0.95, 0.90),
)

# Run history
STAGES = ("etl", "stats", "supply_chain", "ml", "capacity", "sensing", "sop")

# Operations
RATE_LIMIT_PER_MINUTE = 30
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
