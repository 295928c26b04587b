"""Where rows come from: files, literal rows, versioned tables."""
