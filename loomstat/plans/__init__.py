"""Settings and the stages of an experiment."""
