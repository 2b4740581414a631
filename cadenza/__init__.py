"""Music-library, audio-feature and listening-behaviour analytics on Spark."""
