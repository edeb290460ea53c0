"""Reading corpora, manifests, templates and result files; writing results."""
