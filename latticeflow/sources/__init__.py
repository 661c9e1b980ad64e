"""Sources and sinks: object archives, key-value library, audio files, ground truth, pictures."""
