"""What can be done with spectra: writing, selecting, reading, indexing."""
