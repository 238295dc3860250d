"""Early-warning work on multichannel sampled signals as Spark jobs: windows, features, alarms, metrics, statistics."""
