"""Time-coded text on Spark: word timelines, intervals, segmentations and their scores."""
