"""ticketloom: a PySpark-native engine for support-ticket and web-document text."""
