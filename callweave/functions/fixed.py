"""Fixed values that results depend on."""

# Words that mark a legal "safe harbor" passage.
SAFE_HARBOR_WORDS = [
    "safe", "harbor", "forwardlooking", "forward-looking", "forward", "looking", "actual",
    "statements", "statement", "risk", "risks", "uncertainty", "uncertainties", "future",
    "events", "sec", "results",
]

# Phrases that mark a passage on their own.
SAFE_HARBOR_PHRASES = ["forward-looking", "forward looking"]

# Colours of the document scatter, reused cyclically, and the colour of outliers.
DOCUMENT_PALETTE = [
    "#377eb8", "#4daf4a", "#984ea3", "#ff7f00", "#e41a1c", "#ffff33", "#a65628",
    "#f781bf", "#999999", "#66c2a5", "#fc8d62", "#8da0cb", "#e78ac3", "#a6d854",
    "#ffd92f", "#e5c494", "#b3b3b3", "#1f78b4", "#33a02c", "#fb9a99",
]
OUTLIER_COLOUR = "#999999"

# Colours of the annotated topic scatter, reused cyclically.
TOPIC_PALETTE = [
    "#e6194b", "#3cb44b", "#ffe119", "#4363d8", "#f58231", "#911eb4", "#46f0f0", "#f032e6",
    "#bcf60c", "#fabebe", "#008080", "#e6beff", "#9a6324", "#fffac8", "#800000", "#aaffc3",
    "#808000", "#ffd8b1", "#000075", "#808080", "#ffffff", "#000000",
]
