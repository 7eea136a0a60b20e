"""Values that fix results. They are facts of the domain the engine reproduces, kept as plain tables."""

# Weights of the six parts of influence.
INFLUENCE_WEIGHTS = {"betweenness": 0.30, "pagerank": 0.25, "degree": 0.15, "eigenvector": 0.15, "prior": 0.10, "bridging": 0.05}
# Base weight of an edge by type; any other type has EDGE_WEIGHT.
EDGE_WEIGHTS = {
    "CALLED": 1.0, "TRANSACTED_WITH": 1.0, "SHARES_HANDSET": 1.4, "INSTRUCTED_BY": 1.3, "REPORTS_TO": 1.3, "SUPPLIED_BY": 1.2, "DIRECTOR_OF": 1.2,
    "LINKED_TO_ORG": 0.8, "ASSOCIATE_OF": 0.7, "CO_NAMED_IN": 0.6, "CONTROLS_AREA": 0.5, "SEEN_AT": 0.4, "USED_VEHICLE": 0.4,
}
EDGE_WEIGHT = 0.5
# Reporting threshold of cash payments, and the band under it that counts as structuring.
CASH_THRESHOLD, CASH_BAND = 50_000, 0.85
# Earth radii of the corpus and of the case engine, km.
RADIUS_CORPUS, RADIUS_CASE = 6371.0, 6371.0088
# Speeds (km/h), distances (km) and times (minutes) of movement checks.
MAX_SPEED, UNUSUAL_SPEED, CASE_SPEED = 120.0, 80.0, 100.0
MIN_SEPARATION_KM, MIN_INTERVAL_MIN, STATED_SLACK_MIN = 1.5, 2.0, 15.0
# Timeline and place windows of the case engine.
PROXIMITY_MIN, GAP_HOURS, CO_LOCATION_KM, NEARBY_KM = 30, 12, 0.05, 2.0
CLAIM_TOLERANCE_MIN, CLAIM_NEAR_MIN = 15, 5
# Reliability of sources without an entry, cap of the effect of contradictions, severity ratios.
RELIABILITY, IMPACT_CAP, SEVERE, MODERATE = 0.60, 0.45, 0.50, 0.25
# Bridge score weights, threshold.
BRIDGE_WEIGHTS, BRIDGE_LEAST = (0.45, 0.35, 0.20), 0.25
# Hypothesis score weights.
HYPOTHESIS_WEIGHTS = (0.30, 0.20, 0.20, 0.15, 0.15)
