"""DataFrame operators over long panels."""
