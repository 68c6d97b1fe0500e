"""Query trees, options and their resolution on the driver."""
