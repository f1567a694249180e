"""Tables, files, manifests and the mutations that are written back."""
