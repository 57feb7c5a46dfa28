"""Where rows come from: web pages, office files, layout tables."""
