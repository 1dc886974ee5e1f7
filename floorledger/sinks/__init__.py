"""Where results and ledgers are written."""
