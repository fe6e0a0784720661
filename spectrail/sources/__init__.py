"""Where spectra come from: datasets and their manifests, archives, mzML files."""
