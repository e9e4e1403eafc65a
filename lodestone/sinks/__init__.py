"""Writers of mesh and model files."""
